"""Plans: the query registry, the DuckDB oracles and the checker."""
