"""Independent DuckDB statements of the registered queries (the correctness oracles)."""
