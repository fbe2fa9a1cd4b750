"""Contact-quality and relationship analytics on Spark."""
