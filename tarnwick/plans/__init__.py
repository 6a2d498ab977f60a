"""Declarative pipelines and the named queries."""
