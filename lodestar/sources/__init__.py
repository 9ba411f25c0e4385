"""Vector, ground-truth and summary files."""
