"""Comparing images: where two differ, as merged hunks, masks, blocks or tiles.

Images are compared chunk by chunk after an equi-join on chunk number; inside a chunk NumPy finds the runs of
differing bytes. What crosses a chunk's edge is put together again by windows over runs, of which there are far
fewer than bytes, so that an image of any size is spread over the cluster and nothing is exploded by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .images import CHUNK


def chunked(images: DataFrame, key: str, column: str, chunk: int = CHUNK) -> DataFrame:
    """(key, chunk_no, bytes) of whole images in a column."""
    numbers = F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(0L, (octet_length({column}) - 1L) div {chunk})"))
    rows = images.select(key, column, F.explode(numbers).alias("chunk_no"))
    return rows.select(key, "chunk_no", F.col(column).substr((F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk)).alias("bytes"))


def differing(source: bytes, target: bytes) -> np.ndarray:
    """Which bytes of the target are not the source's; beyond the source all are."""
    a, b = np.frombuffer(source, np.uint8), np.frombuffer(target, np.uint8)
    out = np.ones(len(b), bool)
    n = min(len(a), len(b))
    out[:n] = a[:n] != b[:n]
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def changed_runs(source: DataFrame, target: DataFrame, key: str = "pair_id", chunk: int = CHUNK, zero_extended: bool = False, gap: int = 0) -> DataFrame:
    """(key, start, end): runs of differing bytes, cut at the edges of chunks. ``zero_extended``: beyond its end
    an image counts as zeros, and the longer one decides the extent. Runs of a chunk that lie at most ``gap`` bytes
    apart are one row."""
    a, b = (x.select(key, "chunk_no", F.col("bytes").alias(n)) for x, n in ((source, "a"), (target, "b")))
    both = a.join(b, [key, "chunk_no"], "full" if zero_extended else "right")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ident, no, x, y = (batch.column(i)[k].as_py() for i in range(4))
                x, y = x or b"", y or b""
                if zero_extended:
                    n = max(len(x), len(y))
                    x, y = x.ljust(n, b"\0"), y.ljust(n, b"\0")
                s, e = runs(differing(x, y))
                if len(s):
                    apart = s[1:] - e[:-1] > gap
                    s, e = s[np.append(True, apart)], e[np.append(apart, True)]
                    base = no * chunk
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ident)), pa.array(s + base), pa.array(e + base)], names=[key, "start", "end"])

    return both.mapInArrow(work, f"{key} long, start long, end long")


def merged(found: DataFrame, gap: int, key: str = "pair_id") -> DataFrame:
    """Runs that lie at most ``gap`` bytes apart become one hunk (W2): gaps and islands."""
    w = Window.partitionBy(key).orderBy("start")
    fresh = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(0))
    rows = found.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def hunks(source: DataFrame, target: DataFrame, gap: int = 5, key: str = "pair_id", chunk: int = CHUNK) -> DataFrame:
    """(key, start, end): the hunks that make the target of the source."""
    return merged(changed_runs(source, target, key, chunk, gap=gap), gap, key)


def xor_blocks(source: DataFrame, target: DataFrame, key: str = "pair_id", chunk: int = CHUNK) -> DataFrame:
    """(key, start, end, skip): maximal runs over both images, and the bytes skipped since the byte after the
    block before (C3, W13)."""
    found = merged(changed_runs(source, target, key, chunk, True), 0, key)
    last = F.lag("end").over(Window.partitionBy(key).orderBy("start"))
    return found.withColumn("skip", F.col("start") - F.coalesce(last + 1, F.lit(0)))


def changed_blocks(source: DataFrame, target: DataFrame, key: str = "pair_id") -> DataFrame:
    """Numbers of the chunks that differ (C6); what an image lacks counts as zeros. No Python: bytes compare
    in the JVM."""
    a, b = (x.select(key, "chunk_no", F.col("bytes").alias(n)) for x, n in ((source, "a"), (target, "b")))
    both = a.join(b, [key, "chunk_no"], "full")
    empty = F.lit(b"")
    n = F.greatest(F.octet_length(F.coalesce("a", empty)), F.octet_length(F.coalesce("b", empty)))
    x, y = (F.rpad(F.coalesce(c, empty), n, F.lit(b"\0")) for c in ("a", "b"))
    return both.filter(x != y).select(key, "chunk_no")


def tiles(found: DataFrame, sizes: DataFrame, key: str = "pair_id") -> DataFrame:
    """The target as changed pieces and the copies between them (C4): (key, start, end, op). ``sizes``: key and
    target_size."""
    w = Window.partitionBy(key).orderBy("start")
    rows = found.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    inner = rows.filter("start > before").select(key, F.col("before").alias("start"), F.col("start").alias("end"), F.lit("copy").alias("op"))
    last = found.groupBy(key).agg(F.max("end").alias("start"))
    tail = sizes.join(last, key, "left").select(key, F.coalesce("start", F.lit(0)).alias("start"), F.col("target_size").alias("end"))
    tail = tail.filter("`end` > `start`").withColumn("op", F.lit("copy"))
    return found.select(key, "start", "end", F.lit("data").alias("op")).unionByName(inner).unionByName(tail)


def byte_runs(images: DataFrame, least: int = 4, key: str = "image_id") -> DataFrame:
    """(key, start, end, value): maximal runs of one byte, of ``least`` or more (W10), over whole images."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[k].as_py() or b"", np.uint8)
                edge = np.concatenate([[0], np.flatnonzero(np.diff(data)) + 1, [len(data)]])
                s, e = edge[:-1], edge[1:]
                keep = e - s >= least
                if keep.any():
                    ident = batch.column(0)[k].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(keep.sum()), ident)), pa.array(s[keep]), pa.array(e[keep]), pa.array(data[s[keep]].astype(np.int32))],
                        names=[key, "start", "end", "value"],
                    )

    return images.select(key, "bytes").mapInArrow(work, f"{key} long, start long, end long, value int")
