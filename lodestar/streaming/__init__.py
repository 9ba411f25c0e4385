"""Search over streams of queries."""
