"""streaming of the paired-evaluation library."""
