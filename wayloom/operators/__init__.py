"""Relational, graph and spatial operators."""
