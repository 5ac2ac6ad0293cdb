"""Oracle SQL (DuckDB dialect) for the registered queries."""
