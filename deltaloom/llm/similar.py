"""Near copies of a least similarity, found through wide SimHash fingerprints and verified exactly.

A document is the set of its word shingles. Its fingerprint has ``WORDS`` words of 64 bits, each the SimHash of the set
under a hash of its own, and is embedded as the bit counts of its segments of two bits (see ``simhash``). Two sets of
Jaccard similarity J differ in a share arccos(2J / (1 + J)) / pi of the bits, 15 % at 0.8, so their counts agree
in 73 % of the segments. A grid's cells are the counts of some segments; there are as many grids as make
pairs of the least similarity meet in one of them with a chance of about 0.98 (of similarity 0.85, 0.998). More
rows make for grids of more segments and for more of them, so that cells stay small and the chance is the same.

In a cell, pairs whose embeddings lie within the Manhattan distance ``FAR`` and whose fingerprints lie within that
Hamming distance are candidates. All are verified by their whole sets: a link is a pair whose exact Jaccard
similarity reaches the threshold, so no documents are linked that are less alike.

* A cell's group of at most ``FEW`` connected fingerprints hands on all its candidates. A larger one hands on a star
  around the fingerprint nearest to the group's majority, and its members; of a node's stars a few are taken. After the stars are verified and
  connected, clusters of such groups that are not yet one component are dealt as tiles of ``BLOCK`` with their whole
  sets: a tile compares its candidates of different components, and only links leave it.
* Cells of more than ``TILE`` fingerprints are dealt as tiles, and a hub's partners in blocks, so that no task gets
  more than that.

Equal sets are one node from the start, named by a 64-bit hash. Defined results are those of ``simhash``: null and empty
texts have the empty set and are copies of one another, a text of fewer words than a shingle is one shingle, a null
``doc_id`` ranks last, texts are read whole, other columns may have any name, empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._io import byte_slices, drop_staged, hot_join, stage, tidy
from .components import components
from .substring import mix

WORDS, FAR = 4, 64
FEW, TILE, BLOCK, HUBS = 8, 4_096, 512, 4
#: Similarities are whole thousandths, so that all comparisons are of whole numbers.
UNIT = 1000
U = np.uint64
EVEN = U(simhash.EVEN)
PRINTS = [f"f{k}" for k in range(WORDS)]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(np.array(simhash.shingle_hashes(text, size), U))


def node_of(found: np.ndarray) -> int:
    """The name of a sorted set, as a long."""
    return simhash.signed(xxhash.xxh64_intdigest(found.tobytes())) if len(found) else 0


def wide_prints(each: list[np.ndarray]) -> np.ndarray:
    """A row of ``WORDS`` words for each set."""
    sizes = np.array([*map(len, each)], np.int64)
    flat = np.concatenate([*each, np.zeros(0, U)])
    out = [simhash.majority_bits(mix(flat + U((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)), sizes) for k in range(WORDS)]
    return np.column_stack(out)


def counts(x: np.ndarray) -> np.ndarray:
    """The embedding: for each two bits of a word how many are set, in the place of the two."""
    a, b = x & EVEN, x >> U(1) & EVEN
    return (a ^ b) | (a & b) << U(1)


def plan(n: int) -> tuple[int, int]:
    """Segments of a grid, and grids: cells of about 100 of ``n`` fingerprints that are not alike, and the same
    chance of meeting whatever n is."""
    segments = max(8, math.ceil(math.log(max(1, n) / 100) / math.log(1 / 0.375)))
    return segments, round(64 / 0.733 ** (segments - 8))


def grid_masks(segments: int, grids: int) -> np.ndarray:
    """Which segments each grid reads, as masks of the words."""
    rng = np.random.default_rng(5)
    out = np.zeros((grids, WORDS), U)
    for row in out:
        for s in rng.choice(32 * WORDS, segments, replace=False).tolist():
            row[s // 32] |= U(3 << 2 * (s % 32))
    return out


def cell_names(prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(fingerprints x grids): the names of the cells."""
    at = counts(prints)
    out = np.broadcast_to(mix(np.arange(1, len(masks) + 1).astype(U)), (len(at), len(masks)))
    for k in range(WORDS):
        out = mix(out * U(3) + (at[:, k, None] & masks[:, k]))
    return out


def candidates(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of fingerprints (sets of nx and ny shingles) may be links."""
    ok = UNIT * np.minimum(nx, ny) >= least * np.maximum(nx, ny)
    at = np.flatnonzero(ok)
    far = np.zeros(len(at), np.int64)
    for k in range(WORDS):  # the distance of the counts is at most that of the bits
        if not len(at):
            break
        d = counts(x[at, k]) ^ counts(y[at, k])
        low, high = d & EVEN, d >> U(1) & EVEN
        far = far + np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)
        near = far <= FAR
        at, far = at[near], far[near]
    if len(at):
        at = at[np.bitwise_count(x[at] ^ y[at]).sum(1) <= FAR]
    out = np.zeros(len(ok), bool)
    out[at] = True
    return out


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that links lead to, for each place."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def grouped(keys: np.ndarray, prints: np.ndarray, sizes: np.ndarray, least: int, few: int = FEW):
    """Of runs of equal keys (cells): pairs of places (a, b, block), and for each place its large group or -1."""
    n = len(keys)
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n)
    starts = np.append(0, ends[:-1])
    small = ends - starts <= 256
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stop = np.repeat(np.where(small, ends, 0), ends - starts)
    at, s = np.flatnonzero(stop), 1
    while len(at := at[at + s < stop[at]]):  # all pairs of the small cells, by their distance in the order
        hit = at[candidates(prints[at], prints[at + s], sizes[at], sizes[at + s], least)]
        left.append(hit)
        right.append(hit + s)
        s += 1
    pairs = np.concatenate(left), np.concatenate(right)
    for a, b in zip(starts[~small], ends[~small]):  # a search that compares each with those not yet reached
        rest, todo = np.arange(a, b), []
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            i = todo.pop()
            hit = candidates(np.broadcast_to(prints[i], (len(rest), WORDS)), prints[rest], np.broadcast_to(sizes[i], len(rest)), sizes[rest], least)
            if hit.any():
                near, rest = rest[hit], rest[~hit]
                left.append(np.full(len(near), i))
                right.append(near)
                todo += near.tolist()
    label = _labels(n, np.concatenate(left), np.concatenate(right))
    many = np.bincount(label, minlength=n)
    large = np.where(many[label] > few, label, -1)
    keep = large[pairs[0]] < 0
    out = [(pairs[0][keep], pairs[1][keep], np.zeros(int(keep.sum()), np.int64))]
    in_small_cell = np.repeat(small, ends - starts)
    order = np.argsort(label, kind="stable")
    bounds = np.append(0, np.cumsum(many[many > 0]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = order[a:b]
        if len(own) > few:
            hub = own[_middle(prints[own])]
            own = own[own != hub]
            out.append((np.full(len(own), hub), own, 1 + np.arange(len(own)) // BLOCK))
        elif len(own) > 1 and not in_small_cell[own[0]]:
            i, j = np.triu_indices(len(own), 1)
            out.append((own[i], own[j], np.zeros(len(i), np.int64)))
    a, b, block = (np.concatenate(c) for c in zip(*out))
    ok = candidates(prints[a], prints[b], sizes[a], sizes[b], least) if len(a) else np.zeros(0, bool)
    return a[ok], b[ok], block[ok], large


def _middle(prints: np.ndarray) -> int:
    """The place of the fingerprint nearest to the bits that most have."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1)
    return int((bits != (2 * bits.sum(0, dtype=np.int64) > len(bits))).sum(1).argmin())


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy().view(U) for f in PRINTS])


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(rid, doc_id, node, n, f0, ...) of every row, staged."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                each = [shingle_set(t, size) for t in part.column("text").to_pylist()]
                prints = wide_prints(each).view(np.int64)
                node, n = pa.array([*map(node_of, each)], pa.int64()), pa.array([*map(len, each)], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), node, n, *map(pa.array, prints.T)], names=["doc_id", "node", "n", *PRINTS])

    schema = f"doc_id {id_type}, node long, n long, " + ", ".join(f"{f} long" for f in PRINTS)
    return stage(rows.mapInArrow(tidy(run), schema).withColumn("rid", F.monotonically_increasing_id()), "wide_prints")


def met(nodes: DataFrame, least: int, tile: int, few: int, plan_=plan) -> DataFrame:
    """(a, b, block, grp): candidates, and members of the large groups (grp) of cells: b where it is a candidate of the
    group's star, else a alone. Staged."""
    masks = grid_masks(*plan_(nodes.count()))
    step = max(1, (1 << 16) // len(masks))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                key = cell_names(_columns(part), masks).view(np.int64)
                again = pa.array(np.repeat(np.arange(part.num_rows), len(masks)))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(c.take(again) for c in part.columns)], names=["key", *part.schema.names])

    columns = ["node", "n", *PRINTS]
    cells = nodes.filter("n > 0").select(*columns).mapInArrow(tidy(emit), "key long, " + ", ".join(f"{c} long" for c in columns))
    big = stage(cells.groupBy("key").count().filter(F.col("count") > tile), "large_cells")
    if not big.isEmpty():
        # a fingerprint of a large cell goes to all tiles (i, j), i <= j, of its own part
        zero, parts = F.lit(0).cast("long"), F.ceil(F.col("count") * 2 / tile).cast("long")
        tiles = F.transform(F.sequence(zero, F.col("parts") - 1), lambda k: F.least(k, "mine") * F.col("parts") + F.greatest(k, "mine"))
        # cells that large hold at least ``tile`` of the rows each
        cells = cells.join(big, "key", "left").withColumn("parts", F.coalesce(parts, F.lit(1).cast("long"))).withColumn("mine", F.pmod(F.xxhash64("node"), "parts"))
        cells = cells.withColumn("tile", F.explode(tiles)).withColumn("key", F.when(F.col("parts") > 1, F.xxhash64("key", "tile")).otherwise(F.col("key"))).select("key", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches):
            key, node = part.column("key").to_numpy(), part.column("node").to_numpy()
            a, b, block, large = grouped(key, _columns(part), part.column("n").to_numpy(), least, few)
            name = mix(key.view(U) * U(3) + mix(node[large].view(U))).view(np.int64)
            if len(a):
                group = pa.array(name[b], mask=block == 0)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(block), group], names=["a", "b", "block", "grp"])
            alone = large >= 0
            alone[b[block > 0]] = False
            of = np.flatnonzero(alone)
            if len(of):
                none = pa.nulls(len(of), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node[of]), none, none, pa.array(name[of])], names=["a", "b", "block", "grp"])

    dealt = cells.repartition("key").sortWithinPartitions("key")
    return stage(dealt.mapInArrow(tidy(run), "a long, b long, block long, grp long"), "met")


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, put together so that no key is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = all_.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield all_.slice(0, cut)
            held = [all_.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def between(members: DataFrame, whole: DataFrame, least: int, part: int = BLOCK // 2) -> DataFrame:
    """(a, b): verified links between different components in (cluster, node, n, label, f0, ...). A cluster's nodes are
    split into parts, and each pair of parts is a tile with its whole sets: what is compared stays in the task, and
    only links leave it."""
    sizes = members.groupBy("cluster").count()
    zero, parts = F.lit(0).cast("long"), F.ceil(F.col("count") / part).cast("long")
    dealt = members.join(sizes, "cluster").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node"), "parts")).drop("count")
    tiles = F.transform(F.sequence(zero, F.col("parts") - 1), lambda k: F.least(k, "mine") * F.col("parts") + F.greatest(k, "mine"))
    dealt = dealt.join(whole, "node").withColumn("tile", F.explode(tiles)).withColumn("key", F.xxhash64("cluster", "tile"))
    dealt = dealt.withColumn("within", F.col("tile") % (F.col("parts") + 1) == 0).select("key", "node", "n", "label", "mine", "within", "shingles", *PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_keys(batches, BLOCK):
            keys, node, n, label, mine = (some.column(c).to_numpy() for c in ("key", "node", "n", "label", "mine"))
            within, prints, lists = some.column("within").to_numpy(zero_copy_only=False), _columns(some), some.column("shingles")
            flat, at = lists.values.to_numpy().view(U), lists.offsets.to_numpy()
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            for s, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                for i in range(s, e):
                    rest = np.arange(i + 1, e)
                    # a tile of two parts compares those of one with those of the other
                    rest = rest[(label[rest] != label[i]) & (within[i] | (mine[rest] != mine[i]))]
                    rest = rest[candidates(np.broadcast_to(prints[i], (len(rest), WORDS)), prints[rest], np.broadcast_to(n[i], len(rest)), n[rest], least)]
                    if len(rest):
                        rest = rest[alike(flat[at[i] : at[i + 1]], flat, at, rest, least)]
                    if len(rest):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), node[i])), pa.array(node[rest])], names=["a", "b"])

    return stage(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long"), "verified")


def alike(hub: np.ndarray, flat: np.ndarray, at: np.ndarray, some: np.ndarray, least: int) -> np.ndarray:
    """Which of ``some`` lists (of ``flat``, from ``at`` on; none is empty) are as similar to ``hub`` as asked."""
    sizes = at[some + 1] - at[some]
    first = np.cumsum(sizes) - sizes
    own = flat[np.repeat(at[some] - first, sizes) + np.arange(sizes.sum())]
    place = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
    common = np.add.reduceat((hub[place] == own).astype(np.int64), first)
    return common * (UNIT + least) >= least * (sizes + len(hub))


def whole_sets(docs: DataFrame, size: int, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, shingles) of the ``needed`` nodes, made again from the text of one document of each. Staged."""
    ids = stage(nodes.join(needed, "node").select(F.col("least").alias("id")).distinct(), "candidate_ids")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text"):
                each = [shingle_set(t, size) for t in part.column(0).to_pylist()]
                ends = np.cumsum([0, *map(len, each)])
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([*map(node_of, each)], pa.int64()), held], names=["node", "shingles"])

    found = texts.mapInArrow(tidy(run), "node long, shingles array<long>").join(needed, "node", "left_semi")
    return stage(found.dropDuplicates(["node"]), "candidate_sets")


def verified(pairs: DataFrame, whole: DataFrame, least: int) -> DataFrame:
    """(a, b) of those pairs (a, b, block) whose sets are as similar as asked. A set travels once for each of its
    hubs' blocks, and a task holds one hub's set at a time."""
    key = F.xxhash64("a", "block")
    ends = pairs.select(key.alias("key"), F.lit(0).alias("rank"), F.col("a").alias("node")).distinct()
    ends = ends.union(pairs.select(key.alias("key"), F.lit(1).alias("rank"), F.col("b").alias("node")))
    dealt = ends.join(whole, "node").repartition("key").sortWithinPartitions("key", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub, hub_node = None, np.zeros(0, U), 0
        for batch in batches:
            keys, rank, node = (batch.column(c).to_numpy() for c in ("key", "rank", "node"))
            if not len(keys):
                continue
            lists = batch.column("shingles")
            flat, ends = lists.values.to_numpy().view(U), lists.offsets.to_numpy()
            cut = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            for s, e in zip(np.append(0, cut[:-1]).tolist(), cut.tolist()):
                if keys[s] != held:
                    held, hub, hub_node = keys[s], flat[ends[s] : ends[s + 1]].copy(), node[s]
                s += int((rank[s:e] == 0).sum())
                if s == e or not len(hub):
                    continue
                ok = np.flatnonzero(alike(hub, flat, ends, np.arange(s, e), least))
                if len(ok):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), hub_node)), pa.array(node[s:e][ok])], names=["a", "b"])

    return stage(dealt.select("key", "rank", "node", "shingles").mapInArrow(tidy(run), "a long, b long"), "verified")


def links(docs: DataFrame, size: int, nodes: DataFrame, least: int, tile: int = TILE, few: int = FEW, part: int = BLOCK // 2) -> DataFrame:
    """(a, b): links among the nodes."""
    found = met(nodes, least, tile, few)
    pairs = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.min("block").alias("block"))
    # of the hubs of a node, one or none for each grid, the first few do: what they do not connect is left to the tiles
    hubs = F.slice(F.array_sort(F.collect_list(F.struct("a", "block"))), 1, HUBS)
    stars = pairs.filter("block > 0").groupBy("b").agg(hubs.alias("h")).select("b", F.explode("h").alias("h")).select("h.a", "b", "h.block")
    pairs = stage(pairs.filter("block = 0").unionByName(stars), "pairs")
    members = stage(found.filter("grp IS NOT NULL").select(F.col("grp").alias("key"), F.coalesce("b", "a").alias("node")), "members")
    drop_staged(found)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node"))
    whole = whole_sets(docs, size, nodes, stage(ends.distinct(), "candidates"))
    first = verified(pairs, whole, least)
    if members.isEmpty():
        return first
    # groups of different cells that share a node are one cluster
    least_of = members.groupBy("key").agg(F.min("node").alias("first"))
    clusters = components(members.join(least_of, "key").select("first", "node")).select("node", F.col("component").alias("cluster"))
    labels = members.select("node").distinct().join(clusters, "node").join(components(first).select("node", F.col("component").alias("label")), "node", "left")
    labels = stage(labels.withColumn("label", F.coalesce("label", "node")), "members")
    open_ = labels.groupBy("cluster").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("cluster")
    groups = labels.join(open_, "cluster").join(nodes.select("node", "n", *PRINTS), "node")
    return first.union(between(groups, whole, least, part))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """(doc_id, fp, component, component_id), one row per row of ``docs``; ``fp`` names the set of shingles. Staged."""
    rows = sets(docs, size)
    each = [F.first(c).alias(c) for c in ("n", *PRINTS)]
    nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("least"), *each), "nodes")
    found = components(links(docs, size, nodes, round(similarity * UNIT), **how))
    both = nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    both = stage(both, "components")
    ids = stage(both.groupBy("component").agg(F.min("least").alias("component_id")), "component_ids")
    named = stage(hot_join(both.select("node", "component"), ids, "component"), "named")
    out = hot_join(rows.select("doc_id", "node"), named, "node").withColumnRenamed("node", "fp")
    out = stage(out.select("doc_id", "fp", "component", "component_id"), "near")
    drop_staged(rows)
    return out


def deduplicate(docs: DataFrame, size: int = 5, similarity: float = 0.8, **how) -> DataFrame:
    """The rows of ``docs`` that stay, by the rule of ``simhash.deduplicate``."""

    @F.pandas_udf("long")
    def node(text):
        return pd.Series([node_of(shingle_set(t, size)) for t in text], dtype="int64")

    named = lambda rows: rows.withColumn("fp", node(F.col("doc.text").cast("string")))
    return simhash.first_rows(docs, near_duplicates(docs, size, similarity, **how), named)
