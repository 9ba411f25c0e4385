"""Clean-up of labels as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_label(text: Column) -> Column:
    """Small letters, digits, ``_`` and ``-``; any other byte becomes ``_``; an empty label ``experiment``."""
    by_byte = F.decode(text.cast("binary"), "ISO-8859-1")
    clean = F.lower(F.regexp_replace(by_byte, "[^A-Za-z0-9_-]", "_"))
    return F.when(clean == "", F.lit("experiment")).otherwise(clean)
