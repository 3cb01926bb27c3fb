"""Listening-history analytics on Spark."""
