"""Token ids on disk: ORC with integer run-length encoding, row indexes and Bloom filters.

Layout of a token file set (one folder):

* files in ascending ``doc_id`` order by part number, rows in ascending ``doc_id``
  order within a file (equal ids by a hash of the text, then by text; null ids
  first);
* ``doc_id``, ``n_tokens``, ``first_token`` (position of the document's first
  id within its part) and ``token_ids``;
* every stripe has a row index and a Bloom filter on ``doc_id``, so that a
  reader with a filter on ``doc_id`` skips stripes and row groups; stripes of
  one file are read by different tasks.

A null text is an empty one: its ids are the end id alone.  Extra columns of
the input are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import bytebpe
from lodestar.runtime import ship, task_count, tidy

SCHEMA = "doc_id long, n_tokens long, first_token long, token_ids array<int>"


def _with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids with the end id behind them."""
    rows = np.arange(len(at))
    out = np.empty(len(ids) + len(at) - 1, np.int32)
    ends = at[1:] + rows[:-1]
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep], out[ends] = ids, end_id
    return out, at + rows


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, codec: str = "none", stripe_bytes: int = 16 << 20) -> None:
    """Encode ``docs(doc_id, text)`` and write the token files at ``path``.

    The texts, smaller than their ids, are what the one shuffle moves.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, first = bytebpe.encoder(tokenizer), 0
        for batch in batches:
            doc_id = batch.column(0)
            for a, b, ids, at in coder.batches(batch.column(1)):
                ids, at = _with_end(ids, at, end_id)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([doc_id.slice(a, b - a), pa.array(np.diff(at)), pa.array(first + at[:-1]), lists], ["doc_id", "n_tokens", "first_token", "token_ids"])
                first += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash splits an id with very many texts; ids and hashes alone are sampled for the ranges
    order = ("doc_id", F.xxhash64("text"))
    ordered = rows.repartitionByRange(task_count(docs), *order).sortWithinPartitions(*order, "text")
    writer = ordered.mapInArrow(tidy(encode), SCHEMA).write.option("compression", codec)
    for key, value in {"orc.stripe.size": stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": 1000, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01}.items():
        writer = writer.option(key, str(value))
    writer.orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with ``start``: the number of ids of all documents before.

    A filter on ``doc_id`` reaches the ORC reader.  The sizes of whole
    parts come from one pruned column; there is one row for each part.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-([0-9]+)", 1).cast("int")
    files = spark.read.schema(SCHEMA).orc(path).withColumn("part", number)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each written part, and writing bounds their number by input bytes / task bytes.
    places = F.broadcast(totals.select("part", before.alias("before")))
    return files.join(places, "part").select("doc_id", (F.col("before") + F.col("first_token")).alias("start"), "n_tokens", "token_ids")


def token_digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows of token ids, from the ids read."""
    ship(tokens.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(2).flatten(), np.asarray(batch.column(2).offsets)
            raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), (at - at[0]) * 4
            crc = [zlib.crc32(raw[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64) // 4), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "token_ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
