"""Repository-evidence analytics on Spark."""
