"""Registered queries over the stand-in tables and their DuckDB oracles."""
