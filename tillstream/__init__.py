"""Retail order-line metrics on Spark, the same functions for tables and streams."""
