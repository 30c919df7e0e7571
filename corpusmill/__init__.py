"""Spark engine for curating rule-driven text datasets."""
