"""Typed semi-structured columns for PySpark."""
