"""WARC archives of captures, and their globally ordered history by external merge.

Writing: one gzip member for each record, one archive for each task, in the
shared folder.  Of captures with equal payloads the one with the smallest
``page_id`` is a ``response`` record, later ones are ``revisit`` records
without payload that refer to it.  Reading: each archive is parsed by one task
and gives one *run*, sorted by URL key and time; range-wise loser-tree merges
of all runs then put every capture into one global order.

Defined results: a null payload or URL is an empty one; captures without
``page_id`` are never referred to, unless all equal ones lack it, and are then
responses all; repeated rows of the smallest ``page_id`` are responses all.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.runtime import new_path, saved, ship, task_count

SALTS = 16
#: So many revisits, two numbers each, go to every task; more are joined by salted keys.
BROADCAST_REVISITS = 500_000
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at long, archive string, offset long"
_COLUMNS = [x.split()[0] for x in CAPTURE.split(", ")]
_ARROW = pa.schema([(x, pa.int64() if t == "long" else pa.string()) for x, t in (y.split() for y in CAPTURE.split(", "))])


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC digests have it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, then port, path and query, without scheme and fragment."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _record(page: int | None, url: str, seconds: int, payload: bytes, digest: str, first: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first is not None
    block = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) or "urn:page:none"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>",
        f"WARC-Date: {datetime.fromtimestamp(seconds, UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """(offset, WARC headers, HTTP headers, payload) of every record of a compressed archive."""

    def headers(text: bytes) -> dict[str, str]:
        pairs = (x.split(": ", 1) for x in text.decode().split("\r\n")[1:] if ": " in x)
        return {k.lower(): v for k, v in pairs}

    at = 0
    while at < len(raw):
        opener, parts, end = zlib.decompressobj(31), [], at
        while not opener.eof:
            if end >= len(raw):
                raise ValueError(f"the record at {at} is cut off")
            parts.append(opener.decompress(raw[end : end + 65536]))
            end += 65536
        body = b"".join(parts)
        head, _, rest = body.partition(b"\r\n\r\n")
        warc = headers(head)
        http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
        yield at, warc, headers(http), payload
        at = min(end, len(raw)) - len(opener.unused_data)


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, refers_to`` of the captures whose payload an earlier page has.

    Digests alone are shuffled.  The smallest page of a payload is found with
    a sum on the map side; the way back to a payload's copies is salted.
    """
    ship(pages.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [hashlib.sha1(b"" if x is None else x).digest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "digest"])

    own = pages.select("page_id", F.col("html").cast("binary")).mapInArrow(digest, "page_id long, digest binary")
    own = saved(own.filter(F.col("page_id").isNotNull()), "warc-digests")
    firsts = own.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).filter("most > refers_to").drop("most")
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["digest", "salt"]).filter("page_id > refers_to").select("page_id", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, captured_at: Column) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives below ``path``; the names of the files, as a saved table.

    A task that runs again writes a file of a new name; only files in the
    returned table count.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"), captured_at.cast("long").alias("at"))
    known = saved(revisits(rows), "warc-revisits")
    if known.count() <= BROADCAST_REVISITS:
        joined = rows.join(F.broadcast(known), "page_id", "left")
    else:  # pages without id refer to none, and those of one id are spread
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.filter(F.col("page_id").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int"))
        lone = rows.filter(F.col("page_id").isNull()).withColumn("refers_to", F.lit(None).cast("long"))
        joined = salted.join(spread, ["page_id", "salt"], "left").drop("salt").unionByName(lone)
    joined = joined.select("page_id", "url", "html", "at", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _folder(path)
        system.create_dir(folder, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                for page, url, html, at, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
                    out.write(_gzip(_record(page, url, at or 0, html, payload_digest(html), first)))
                    n += 1
        finally:
            if out:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["archive", "records"])

    return saved(joined.mapInArrow(write, "archive string, records long"), "warc-files")


def capture_runs(files: DataFrame, path: str) -> DataFrame:
    """One sorted run of captures for each archive, as a saved table; every payload's digest is checked."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _folder(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    raw = source.read()
                run = []
                for offset, warc, http, payload in parse_records(raw):
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    if warc["warc-type"] == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{name}: the payload at {offset} doesn't have its digest")
                    refers = warc.get("warc-refers-to")
                    seconds = int(datetime.fromisoformat(warc["warc-date"]).timestamp())
                    run.append((_page(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"], refers and _page(refers), url_key(warc["warc-target-uri"]), seconds, name, offset))
                run.sort(key=_order)
                yield _batch(run)

    n = max(1, min(files.count(), task_count(files)))
    return saved(files.repartition(n).mapInArrow(read, CAPTURE), "warc-runs")


def _order(row: tuple) -> tuple:
    """URL key, time, then page (without one: first), archive and offset."""
    return row[5], row[6], -1 if row[0] is None else row[0], row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def loser_tree_merge(runs: list[list[tuple]], key=_order) -> Iterator[tuple]:
    """Merge sorted runs: each inner node keeps the loser of its match, so a step replays one path to the root."""
    k = len(runs)
    if not k:
        return
    heads = [0] * k
    keys: list[tuple | None] = [key(run[0]) if run else None for run in runs]

    def beats(a: int, b: int) -> bool:
        """Whether run a's head goes before run b's; exhausted runs go last, equal heads by run."""
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    while keys[top] is not None:
        yield runs[top][heads[top]]
        heads[top] += 1
        keys[top] = key(runs[top][heads[top]]) if heads[top] < len(runs[top]) else None
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def merged_history(runs: DataFrame) -> DataFrame:
    """All captures in one global order: partitions ascend, and rows within them.

    Runs are cut at common range borders on the whole sort key, so that a URL
    with very many captures is spread too; each task merges its slices of all
    runs in memory, which the size of a range bounds.
    """
    ship(runs.sparkSession)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                slices.setdefault(row[7], []).append(row)
        for own in slices.values():  # slices arrive in order as a rule; a sort of sorted rows is one pass
            own.sort(key=_order)
        block = []
        for row in loser_tree_merge([slices[x] for x in sorted(slices)]):
            block.append(row)
            if len(block) == 8192:
                yield _batch(block)
                block = []
        if block:
            yield _batch(block)

    ranged = runs.repartitionByRange(task_count(runs, 16 << 20), "url_key", "captured_at", "page_id", "archive", "offset")
    return ranged.select(*_COLUMNS).mapInArrow(merge, CAPTURE)


def capture_history(pages: DataFrame, captured_at: Column | None = None) -> DataFrame:
    """Write archives for ``pages``, read them back, and return the merged history of captures."""
    path = new_path(pages.sparkSession, "warc")
    when = F.lit(1_704_067_200) + F.coalesce(F.col("page_id"), F.lit(0)) % 31_536_000 if captured_at is None else captured_at
    return merged_history(capture_runs(write_archives(pages, path, when), path))
