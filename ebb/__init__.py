"""ebb: customer-retention analytics as Spark jobs."""
