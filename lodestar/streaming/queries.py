"""Nearest neighbours for a stream of queries; the answers follow the stream's micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.exact import nearest


def answer_stream(queries: DataFrame, base: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Write ``qid, rank, id, distance`` for every micro-batch of ``queries(qid, vector)`` below ``path``.

    Each batch overwrites its own folder, so that a batch that runs again
    leaves one copy of its answers.
    """

    def answer(batch: DataFrame, number: int) -> None:
        nearest(base, batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
