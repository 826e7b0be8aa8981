"""Retail-bank analytics on Spark: contract tables, gold products, point-in-time features, scoring reports."""
