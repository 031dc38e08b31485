"""Corpus audit and evaluation as Spark DataFrame jobs."""
