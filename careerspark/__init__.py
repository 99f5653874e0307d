"""Career-performance analytics on Spark: ordered event histories to graded careers."""
