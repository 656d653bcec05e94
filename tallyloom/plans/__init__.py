"""Queries over the test tables: each applies operators, and most come with DuckDB SQL."""
