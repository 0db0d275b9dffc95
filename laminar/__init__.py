"""Sheet-instance analytics and corpus preparation as Spark jobs."""
