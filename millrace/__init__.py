"""millrace: analytics and corpus preparation written as plain Spark jobs."""
