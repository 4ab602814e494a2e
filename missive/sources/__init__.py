"""Readers of chat exports. Each gives a DataFrame of CANONICAL messages; unknown shapes raise."""
