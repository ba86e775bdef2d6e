"""Shared plan helpers: scratch tables and session access."""
