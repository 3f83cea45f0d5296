"""Per-key forecast selection as set-wise Spark jobs."""
