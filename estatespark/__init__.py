"""Listing analytics and price scoring as Spark DataFrame jobs."""
