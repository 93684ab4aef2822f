"""Registered queries: each applies operators to whole tables, most with a DuckDB twin."""
