"""Retrieval data jobs and training-data operators as Spark DataFrame transformations."""
