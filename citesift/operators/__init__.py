"""Set-at-a-time operators: tables in, tables out."""
