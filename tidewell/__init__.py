"""Geo-aware document intelligence as PySpark DataFrame operators."""
