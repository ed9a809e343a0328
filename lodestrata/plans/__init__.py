"""Registered queries: each plan pairs a Spark query with its SQL where SQL can express it."""
