"""Image-batch analytics on Spark: one row per file, plans instead of work queues."""
