"""Relational operators over document tables; each takes and returns DataFrames."""
