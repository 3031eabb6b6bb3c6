"""sources of the paired-evaluation library."""
