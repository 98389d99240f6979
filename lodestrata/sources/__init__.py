"""Readers that Spark does not have: workbooks, and the strict readers of cleaned tables."""
