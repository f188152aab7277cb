"""Property-market and planning analytics, and corpus preparation, as Spark DataFrame jobs."""
