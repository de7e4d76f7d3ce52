"""Catalogue search and analytics expressed as PySpark DataFrame plans."""
