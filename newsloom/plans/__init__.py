"""Whole runs: a profile from a history, a feed from candidates and a profile."""
