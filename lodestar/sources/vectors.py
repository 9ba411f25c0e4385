"""Vector files as a Spark data source, and writers for them.

Formats (little-endian): ``fvecs`` and ``bvecs`` rows of a 32-bit dimension
and its components; ``bin`` a file head of two 32-bit numbers (rows,
dimension) and all components.  A path may be one file or a folder of parts in
name order; ids are positions over all parts.  A row has one length, so a file
is read in ranges by many tasks.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.functions.distance import matrix
from lodestar.runtime import ship, task_count

RANGE_BYTES = 32 << 20
_ITEM = {"fvecs": ("<f4", 4, 4), "bvecs": ("u1", 4, 1), "bin": ("<f4", 0, 4)}  # type, head of each row, bytes of a component


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if "://" in path or path.startswith("file:") else "file://" + path)


def _parts(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return system, [info]
    found = system.get_file_info(fs.FileSelector(inner))
    return system, sorted((x for x in found if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.base_name)


class _Range(InputPartition):
    def __init__(self, file: str, offset: int, rows: int, first: int, dim: int):
        self.file, self.offset, self.rows, self.first, self.dim = file, offset, rows, first, dim


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[_Range]:
        system, parts = _parts(self.path)
        _, head, width = _ITEM[self.kind]
        out, first, known = [], 0, None
        for info in parts:
            with system.open_input_file(info.path) as source:
                raw = source.read_at(min(8, info.size), 0)
            if self.kind == "bin":
                if len(raw) < 8:
                    raise ValueError(f"{info.path} is too short")
                rows, dim = struct.unpack("<II", raw)
                begin, stride = 8, dim * width
                if info.size != 8 + rows * stride:
                    raise ValueError(f"{info.path} has not as many bytes as its head says")
            elif not info.size:
                continue
            else:
                dim = struct.unpack("<I", raw[:4])[0] if len(raw) >= 4 else 0
                begin, stride = 0, head + dim * width
                rows = info.size // stride
                if rows * stride != info.size:
                    raise ValueError(f"{info.path} is cut off or has rows of several dimensions")
            if not dim or known not in (None, dim):
                raise ValueError(f"{info.path}: dimension {dim} after {known}")
            known = dim
            step = max(1, RANGE_BYTES // max(1, stride))
            out += [_Range(info.path, begin + i * stride, min(step, rows - i), first + i, dim) for i in range(0, rows, step)]
            first += rows
        if not first:
            raise ValueError(f"{self.path} has no vectors")
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        kind, head, width = _ITEM[self.kind]
        system, _ = _open(self.path)
        stride = head + partition.dim * width
        with system.open_input_file(partition.file) as source:
            raw = np.frombuffer(source.read_at(partition.rows * stride, partition.offset), np.uint8).reshape(partition.rows, stride)
        if head and (np.ascontiguousarray(raw[:, :4]).view("<u4") != partition.dim).any():
            raise ValueError(f"{partition.file} has rows of several dimensions")
        flat = np.ascontiguousarray(raw[:, head:]).view(kind).astype(np.float32).ravel()
        ids = pa.array(np.arange(partition.first, partition.first + partition.rows))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, partition.dim, dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([ids, lists], ["id", "vector"])


class VectorFiles(DataSource):
    """``spark.read.format("vectors").option("format", "fvecs" | "bvecs" | "bin").load(path)``: ``id, vector``."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "id long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        kind = self.options.get("format", "fvecs")
        if kind not in _ITEM:
            raise ValueError(f"{kind!r} is no vector format")
        return _Reader(self.options["path"], kind)


def read_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``id, vector`` of a file or folder: ``text``, ``fvecs``, ``bvecs`` or ``bin``."""
    if kind == "text":
        return read_text(spark, path)
    ship(spark)
    spark.dataSource.register(VectorFiles)
    return spark.read.format("vectors").option("format", kind).load(path)


def write_vectors(vectors: DataFrame, path: str, kind: str, parts: int | None = None) -> None:
    """``vectors(id, vector)`` in id order, as parts in name order.

    Each task writes its part anew when it runs again.  Components of
    ``bvecs`` must be whole numbers from 0 to 255.
    """
    ship(vectors.sparkSession)
    item, head, _ = _ITEM[kind]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [matrix(b.column(0)) for b in batches if b.num_rows]
        if held:
            data = np.concatenate(held)
            if kind == "bvecs" and ((data < 0) | (data > 255) | (data != np.floor(data))).any():
                raise ValueError("a component is no byte")
            body = np.ascontiguousarray(data.astype(item)).view(np.uint8).reshape(len(data), -1)
            if head:
                dims = np.full((len(data), 1), data.shape[1], "<u4").view(np.uint8).reshape(len(data), 4)
                body = np.hstack([dims, body])
            system, inner = _open(path)
            system.create_dir(inner, recursive=True)
            number = TaskContext.get().partitionId()
            temporary = f"{inner}/_part-{number:06d}-{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(temporary) as out:
                if kind == "bin":
                    out.write(struct.pack("<II", *data.shape))
                out.write(body.tobytes())
            system.move(temporary, f"{inner}/part-{number:06d}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, held))], pa.int64())], ["n"])

    n = parts or task_count(vectors)
    ordered = vectors.repartitionByRange(n, "id").sortWithinPartitions("id").select(F.col("vector").cast("array<double>"))
    ordered.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_text(spark: SparkSession, path: str, number: str = "float") -> DataFrame:
    """``id, vector`` of white-space separated floats, one vector a line.

    A line without a leading number is skipped; the first word that is no
    number ends its line's values.  Unequal dimensions and files without
    vectors are errors.  Ids are positions among the vectors.
    """
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    numbers = F.transform(words, lambda w: w.try_cast(number))
    stop = F.array_position(F.transform(numbers, lambda x: x.isNull().cast("int")), 1)
    kept = F.when(stop > 0, F.slice(numbers, 1, (stop - 1).cast("int"))).otherwise(numbers)
    # Spark deals files to its tasks by size: only a file's name and where a range of it begins tell the order
    where = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    lines = spark.read.text(path).select(kept.alias("vector"), *where, F.monotonically_increasing_id().alias("line"))
    rows = lines.filter(F.size("vector") > 0)
    shape = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not shape[0]:
        raise ValueError(f"{path} has no vectors")
    if shape[1] != shape[2]:
        raise ValueError(f"{path} has vectors of several dimensions")
    # one small count for each range gives positions without a sort in one task
    counts = sorted(tuple(r) for r in rows.groupBy("file", "begin").count().collect())
    before = np.cumsum([0, *(n for _, _, n in counts)]).tolist()
    starts = spark.createDataFrame([(f, b, s) for (f, b, _), s in zip(counts, before, strict=False)], "file string, begin long, start long")
    place = F.row_number().over(Window.partitionBy("file", "begin").orderBy("line")) - 1
    return rows.withColumn("place", place).join(F.broadcast(starts), ["file", "begin"]).select((F.col("start") + F.col("place")).alias("id"), "vector")


def write_text(vectors: DataFrame, path: str) -> None:
    """One line of floats for each vector, in id order."""
    ordered = vectors.orderBy("id").select(F.concat_ws(" ", F.transform("vector", lambda x: x.cast("string"))).alias("value"))
    ordered.write.text(path)


def toy_vectors(spark: SparkSession, n: int = 12) -> DataFrame:
    """Points on a rising circle: ``(cos t, sin t, i / 10)`` with ``t = 2 pi i / n``."""
    t = F.lit(2 * np.pi) * F.col("id") / F.lit(float(n))
    return spark.range(n).select("id", F.array(F.cos(t), F.sin(t), F.col("id") / 10.0).alias("vector"))


def write_truth(truth: DataFrame, path: str) -> None:
    """``qid, rank, id`` as one line of ids for each query, in query order."""
    lines = truth.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    lines.orderBy("qid").select(F.concat_ws(" ", F.transform("x", lambda x: x["id"].cast("string"))).alias("value")).write.text(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``qid, rank, id`` of lines of ids; queries are numbered by line, blank lines left out."""
    rows = read_text(spark, path, "long").select(F.col("id").alias("qid"), F.posexplode("vector").alias("pos", "x"))
    return rows.select("qid", (F.col("pos") + 1).alias("rank"), F.col("x").cast("long").alias("id"))
