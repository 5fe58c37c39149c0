"""Hazard-exposure analytics as PySpark DataFrame jobs."""
