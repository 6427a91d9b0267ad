"""Peak-to-trough ratios of sequencing coverage, as Spark jobs."""
