"""A findings engine for source text on Spark."""
