"""functions of the paired-evaluation library."""
