"""Readers and writers of tiles, graph documents and tables."""
