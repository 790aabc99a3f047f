"""Clause structure, corpus building, retrieval, run scoring and stream operators as Spark DataFrame transformations."""
