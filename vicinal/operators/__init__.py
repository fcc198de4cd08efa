"""Operators on tables of vectors (id, v), pairs (i, j, d) and edges (src, dst, w)."""
