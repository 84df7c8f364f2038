"""Near-duplicate search on SimHash fingerprints through a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. The 32 counts are
split into ``blocks`` runs; if the distance is at most 4, all but 4 of the blocks have distance zero. So
each choice of ``blocks - 4`` of them is a grid whose cells are their counts, and two linked fingerprints
share a cell of some grid. Within a cell, pairs whose embeddings lie within the Manhattan distance are
verified by the exact Hamming distance.

Equal fingerprints are one node from the start. A cell hands on a spanning forest of its links, never all
pairs; a cell of more than ``TILE`` fingerprints is dealt as tiles of that size, so that a task's memory
and time are bounded and no link is lost. The number of blocks only sets the cost: more grids with smaller
cells for more fingerprints.

Defined results: null and empty texts have fingerprint zero and are linked like any other. A null
``doc_id`` ranks above all others in a component, whose id is its least ``doc_id``. Repeated rows share a
fingerprint. Empty tables give no rows. Other columns may have any name; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._io import byte_slices, drop_staged, hot_join, split_by, stage, tidy
from .components import components

DISTANCE = 4
SEED = 42
TILE = 16_384
LANES = np.uint64(0x0101010101010101)
EVEN = 0x5555555555555555


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of every run of ``size`` words, repeats included; of all words if they are fewer."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return []
    joined = b" ".join(ws)
    ends = [*accumulate(len(w) + 1 for w in ws)]
    if len(ws) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :])]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of ``hashes`` (of the given sizes), the bits that are set in over half of it. Counts
    are added up in eight one-byte lanes of a word, over 255 hashes at a time."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    pieces = -(-sizes // 255)
    first = np.cumsum(sizes) - sizes
    head = np.cumsum(pieces) - pieces
    starts = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(head, pieces))
    bits = np.zeros(len(sizes), np.uint64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & LANES, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        for lane in range(8):
            bits |= (2 * counts[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + j)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): the 64 bits of each row's whole text, as a long."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                each = [shingle_hashes(t, size) for t in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                flat = np.fromiter((h for hs in each for h in hs), np.uint64, int(sizes.sum()))
                fp = majority_bits(flat, sizes).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return rows.mapInArrow(tidy(run), StructType([docs.schema["doc_id"], StructField("fp", LongType())]))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grids(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The masks of the grids: all choices of ``blocks - distance`` of the runs of segments."""
    cut = [32 * k // blocks for k in range(blocks + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Each further block costs about twice the grids and makes a cell 20 times as small."""
    return distance + (2 if n < 4_000_000 else 3 if n < 100_000_000 else 4)


def embed(fp):
    """The counts of all 32 segments, two bits each."""
    a, b = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def linked(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs are links: the Manhattan distance of the embeddings rules out most, the rest is
    verified by the Hamming distance."""
    even, one = np.uint64(EVEN), np.uint64(1)
    d = ((x & even) + (x >> one & even)) ^ ((y & even) + (y >> one & even))
    low, high = d & even, d >> one & even  # counts differ by 1 where low is set, by 2 where only high is
    near = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low) <= distance
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= distance
    return near


def forest(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal keys, all that its links connect."""
    n = len(fps)
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n)
    starts = np.append(0, ends[:-1])
    left, right = [], []
    small = ends - starts <= 256
    if small.any():
        # all pairs of the small cells, by their distance in the order
        stop = np.repeat(np.where(small, ends, 0), ends - starts)
        at, s = np.flatnonzero(stop), 1
        while len(at := at[at + s < stop[at]]):
            hit = at[linked(fps[at], fps[at + s], distance)]
            left.append(hit)
            right.append(hit + s)
            s += 1
    for a, b in zip(starts[~small], ends[~small]):
        # a search that compares each fingerprint with those not yet reached
        rest, todo = np.arange(a, b), []
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            i = todo.pop()
            hit = linked(np.broadcast_to(fps[i], rest.shape), fps[rest], distance)
            if hit.any():
                near, rest = rest[hit], rest[~hit]
                left.append(np.full(len(near), i))
                right.append(near)
                todo += near.tolist()
    if not left:
        return np.zeros(0, fps.dtype), np.zeros(0, fps.dtype)
    i, j = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked_ones = np.flatnonzero(label != np.arange(n))
    return fps[linked_ones], fps[label[linked_ones]]


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links among the distinct ``fp`` that connect all that lie within ``distance`` bits."""
    masks = grids(blocks or blocks_for(fps.count(), distance), distance)
    cell = embed(F.col("fp"))
    cells = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), cell.bitwiseAND(F.lit(signed(m))).alias("cell")) for k, m in enumerate(masks)])).alias("c"),
    ).select("c.grid", "c.cell", "fp")
    large = stage(cells.groupBy("grid", "cell").count().filter(F.col("count") > tile), "large_cells")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        cells = cells.withColumn("tile", zero)
    else:
        # a fingerprint of a large cell goes to all tiles (i, j), i <= j, of its own part
        parts = F.ceil(F.col("count") / tile).cast("long")
        mine = F.pmod(F.xxhash64("fp"), "parts")
        tiles = F.transform(
            F.sequence(zero, F.col("parts") - 1),
            lambda k: F.least(k, "mine") * F.col("parts") + F.greatest(k, "mine"),
        )
        cells = cells.join(large, ["grid", "cell"], "left").withColumn("parts", F.coalesce(parts, F.lit(1).cast("long")))
        cells = cells.withColumn("mine", mine).select("grid", "cell", "fp", F.explode(tiles).alias("tile"))
    key = ["grid", "cell", "tile"]
    dealt = cells.repartition(*key).sortWithinPartitions(*key).select(F.xxhash64(*key).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.append(keys, batch.column(0).to_numpy())
            fp = np.append(fp, batch.column(1).to_numpy().view(np.uint64))
            whole = len(keys) - _last_run(keys) if len(keys) else 0
            if whole and len(keys) >= 100_000:
                yield _pairs(*forest(keys[:whole], fp[:whole], distance))
                keys, fp = keys[whole:], fp[whole:]
        if len(keys):
            yield _pairs(*forest(keys, fp, distance))

    return dealt.mapInArrow(tidy(run), "a long, b long")


def _last_run(keys: np.ndarray) -> int:
    """How many of the last keys are equal."""
    other = np.flatnonzero(keys != keys[-1])
    return len(keys) - 1 - (other[-1] if len(other) else -1)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def classes(prints: DataFrame, distance: int = DISTANCE, **how) -> DataFrame:
    """(fp, component, component_id) for the distinct fingerprints of (doc_id, fp): the least
    fingerprint and the least ``doc_id`` of all that are linked, directly or through others."""
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(links(nodes.select("fp"), distance, **how)).withColumnRenamed("node", "fp")
    both = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    both = stage(both, "components")
    least = stage(both.groupBy("component").agg(F.min("least").alias("component_id")), "component_ids")
    return hot_join(both, least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = DISTANCE, **how) -> DataFrame:
    """(doc_id, fp, component, component_id), one row per row of ``docs``."""
    prints = stage(fingerprints(docs, size), "prints")
    named = stage(classes(prints, distance, **how), "classes")
    return hot_join(prints, named, "fp").select("doc_id", "fp", "component", "component_id")


def deduplicate(docs: DataFrame, size: int = 4, distance: int = DISTANCE, **how) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least ``doc_id`` (of several
    with that id, the one with the least fingerprint, then the greatest by all its columns)."""
    found = stage(near_duplicates(docs, size, distance, **how), "near")
    return first_rows(docs, found, lambda rows: fingerprint_column(rows, size))


def first_rows(docs: DataFrame, found: DataFrame, printed) -> DataFrame:
    """The rows of ``docs`` that stay by ``found``, a staged table of (doc_id, fp, component, component_id);
    ``printed`` adds ``fp`` to rows with a column ``doc``. Texts of rows that stay and share their id with none are not
    moved, but for a few."""
    leads = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = stage(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(leads).alias("leads")), "ids")
    first = found.filter(leads).groupBy("doc_id", "component").agg(F.min("fp").alias("kept_fp"))
    kept = first.withColumnRenamed("doc_id", "kept_id").join(ids, F.col("kept_id").eqNullSafe(F.col("doc_id")))
    kept = stage(kept.select("kept_id", "kept_fp", "rows"), "kept")
    drop_staged(found)
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    sure, rest = split_by(doc, F.col("doc.doc_id"), ids.filter("NOT leads OR rows > 1").select("doc_id"))
    own = lambda part: rest.join(part, F.col("doc.doc_id").eqNullSafe(F.col("kept_id")))
    once = own(kept.filter("rows = 1")).select("doc")
    again = own(stage(kept.filter("rows > 1"), "kept_again")).select("doc", "kept_id", "kept_fp")
    prints = printed(again).filter("fp = kept_fp")
    again = prints.groupBy("kept_id", "kept_fp").agg(F.max("doc").alias("doc")).select("doc")
    return sure.unionByName(once).unionByName(again).select("doc.*")


def fingerprint_column(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with a column ``doc`` and the fingerprint ``fp`` of its text."""

    @F.pandas_udf("long")
    def fp(text):
        each = [shingle_hashes(t, size) for t in text]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return pd.Series(majority_bits(np.array([h for hs in each for h in hs], np.uint64), sizes).view(np.int64))

    return rows.withColumn("fp", fp(F.col("doc.text").cast("string")))
