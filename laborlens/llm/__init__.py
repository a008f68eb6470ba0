"""Training-data operators: dedup, scans, archives, filters and mixing, on Spark."""
