"""pairwell: paired-evaluation analytics as Spark DataFrame and SQL plans."""
