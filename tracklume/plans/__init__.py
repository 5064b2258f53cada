"""Sessions, table views and the registry of queries with their SQL twins."""
