"""Marginalia: set-based study analytics over document corpora, on PySpark."""
