"""Spark-native analytics over filings: pages and cells to validated facts."""
