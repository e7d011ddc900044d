"""Readers: configuration, saved pages, histories, feeds and state."""
