"""Revenue assurance for metered assets, written as PySpark DataFrame jobs."""
