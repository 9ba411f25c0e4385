"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import bytebpe
from lodestar.runtime import saved, ship, tidy


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``length`` (number of ids) of every whole text, one row for each document; null counts as empty."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytebpe.encoder(tokenizer)
        for batch in batches:
            for _, _, _, at in coder.batches(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at))], ["length"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``length, docs``: summed on the map side first, so a hot length is one row for each task.  Saved: texts are encoded once."""
    return saved(lengths.groupBy("length").agg(F.count(F.lit(1)).alias("docs")), "lengths")


def suffix_sums(hist: DataFrame, block: int = 1024) -> DataFrame:
    """For every length that occurs, taken as a context limit:

    ``docs, tokens`` of exactly that length; ``docs_over, tokens_over`` of
    longer documents; ``docs_total, tokens_total`` of all; ``tokens_truncated``
    if each document were cut at the limit; ``share_within`` of documents that
    fit.  Sums run within blocks of lengths and over the few block totals, so
    no task has to hold the whole histogram.  An empty histogram gives no rows.
    """
    own = hist.select("length", "docs", (F.col("length") * F.col("docs")).alias("tokens"), F.floor(F.col("length") / block).alias("block"))
    totals = own.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    behind = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = totals.select("block", over("d", behind).alias("d_over"), over("t", behind).alias("t_over"), F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(blocks, "block").select("length", "docs", "tokens", (F.col("d_over") + over("docs", within)).alias("docs_over"), (F.col("t_over") + over("tokens", within)).alias("tokens_over"), "docs_total", "tokens_total")
    cut = F.col("tokens_total") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    return out.select("length", "docs", "tokens", "docs_over", "tokens_over", "docs_total", "tokens_total", cut.alias("tokens_truncated"), ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("share_within"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: total ids if every document were cut at ``limit``, whether or not that length occurs."""
    return sums.agg(F.coalesce(F.sum(F.col("docs") * F.least(F.col("length"), F.lit(limit))), F.lit(0)).alias("tokens_truncated"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the smallest length within which that share of the documents fits."""
    pairs = [F.min(F.when(F.col("share_within") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    row = sums.agg(*pairs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)])).alias("x")).select("x.*")
