"""Jobs that compose the operators: ingest, train, evaluate, ask."""
