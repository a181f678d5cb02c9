"""Retail reporting and script-corpus processing as PySpark DataFrame jobs."""
