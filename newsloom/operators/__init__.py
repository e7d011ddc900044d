"""Operators on histories and candidate items, DataFrame in, DataFrame out."""
