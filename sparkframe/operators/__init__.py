"""Frame operators: projection, filter, join, group, sort, set operations, alignment."""
