"""Extraction-quality analytics on PySpark."""
