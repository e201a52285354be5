"""Retrieval and ranking evaluation as Spark DataFrame work."""
