"""Whole queries: the outcome plan and the registered queries with their SQL twins."""
