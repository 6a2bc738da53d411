"""Registered queries and their independent DuckDB formulations."""
