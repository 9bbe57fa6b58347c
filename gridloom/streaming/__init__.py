"""Incremental graphs from streams of edges."""
