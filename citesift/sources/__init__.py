"""Reading and writing tables, models, reports and event lines."""
