"""Point-in-time evidence analytics as PySpark transforms."""
