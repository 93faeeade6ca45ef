"""Millrace: document, conversation and board analytics as PySpark jobs."""
