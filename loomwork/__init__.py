"""Hybrid retrieval and relevance analytics as PySpark DataFrame plans."""
