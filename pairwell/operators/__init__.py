"""operators of the paired-evaluation library."""
