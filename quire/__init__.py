"""Ordered-document engine on Spark."""
