"""Vector search and corpus analytics on PySpark DataFrames."""
