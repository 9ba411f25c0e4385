"""SentencePiece encoding and decoding of document tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.pieces import piece_table
from lodestar.llm.textkit import chunks, string_buffers
from lodestar.runtime import ship, tidy

DECODE_IDS = 1 << 19


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids``, ``n_pieces`` and ``round_trip`` of every whole text.

    ``round_trip``: whether the ids, decoded in the same task, spell the text
    again.  Only a text with the model's own space sign (U+2581) doesn't: it
    comes back as a space.  Null and empty texts have no pieces.  Other columns
    pass unchanged, but for columns of these names, which are replaced.  A map
    without shuffle.
    """
    ship(docs.sparkSession)
    rest = docs.drop("piece_ids", "n_pieces", "round_trip")
    schema = T.StructType([*rest.schema, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    place = rest.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, coder = piece_table(model)
        for batch in batches:
            data, offsets = string_buffers(batch.column(place))
            for a, b, ids, at in coder.batches(batch.column(place)):
                raw, begins = table.decode(ids, at)
                own = data[offsets[a] : offsets[b]]
                if len(raw) == len(own) and (raw == own).all() and (np.diff(begins) == np.diff(offsets[a : b + 1])).all():
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([raw[begins[i] : begins[i + 1]].tobytes() == data[offsets[a + i] : offsets[a + i + 1]].tobytes() for i in range(b - a)], bool)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, lists, pa.array(np.diff(at)), pa.array(same)], [*batch.schema.names, "piece_ids", "n_pieces", "round_trip"])

    return rest.mapInArrow(tidy(encode), schema)


def decode_pieces(rows: DataFrame, model: str, ids: str = "piece_ids") -> DataFrame:
    """``rows`` with ``decoded``, the text that the ids of every row spell; null ids spell an empty text."""
    ship(rows.sparkSession)
    rest = rows.drop("decoded")
    schema = T.StructType([*rest.schema, T.StructField("decoded", T.StringType())])
    place = rest.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = piece_table(model)
        for batch in batches:
            lens = np.asarray(batch.column(place).value_lengths().fill_null(0), np.int64)
            for a, b in chunks(np.concatenate([[0], np.cumsum(lens)]), DECODE_IDS):
                own = batch.slice(a, b - a)
                raw, offsets = table.decode(np.asarray(own.column(place).flatten()), np.concatenate([[0], np.cumsum(lens[a:b])]))
                try:
                    text = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(offsets), pa.py_buffer(raw))
                    text.validate(full=True)
                except pa.ArrowInvalid:  # byte pieces that are no UTF-8, from ids that no text gave
                    text = pa.array([raw[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.large_string())
                yield pa.RecordBatch.from_arrays([*own.columns, text.cast(pa.string())], [*batch.schema.names, "decoded"])

    return rest.mapInArrow(decode, schema)
