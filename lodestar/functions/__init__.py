"""Scalar building blocks: distances and label clean-up as columns."""
