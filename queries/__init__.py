"""Registered queries: each module adds ``name -> (Spark callable, DuckDB text or None)``."""
