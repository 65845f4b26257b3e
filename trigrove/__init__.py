"""Wildcard search over JSON documents, on Spark."""
