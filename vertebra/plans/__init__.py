"""Named query plans over the driver tables (Spark side and DuckDB oracle)."""
