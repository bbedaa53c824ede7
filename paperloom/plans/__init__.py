"""Queries over the supplied tables: each is a small plan of operators, with DuckDB SQL that says the same."""
