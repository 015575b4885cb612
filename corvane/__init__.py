"""Deterministic search and evidence processing as Spark DataFrame operators."""
