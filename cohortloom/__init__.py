"""Cohort and code-count analytics written as PySpark DataFrame operators."""
