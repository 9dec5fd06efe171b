"""Molecular surface analytics on Spark."""
