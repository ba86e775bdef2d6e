"""Wayloom: road-graph and corpus analytics as Spark DataFrame plans."""
