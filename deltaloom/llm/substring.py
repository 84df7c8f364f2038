"""Substring dedup by recompression.

A document is a sequence of words; words get global names (64-bit hashes). Rounds then shorten it, as in
Jez's recompression: a *run* round names each maximal run of an equal symbol by symbol and length, a *pair*
round throws a coin for each symbol by its name and names each pair of a left and a right symbol. Names are
hashes of what they stand for, so they agree between all tasks without a dictionary. For each symbol the
words that its making depended on are tracked: where a window of words contains these, every other
occurrence of the window has the same symbol at the same place.

1. Each document hands in the names of its high-level symbols; a window that contains the making of none
   hands in its own name instead. Names that two documents share are found by an aggregation.
2. A window can only occur elsewhere if all its symbols are shared. Such windows are named whole (128 bits),
   and the least document of each is found by a second aggregation: this verifies the long repeats.
3. Windows that also start in a document with a smaller id lose their words.

Exact copies are recognised by digest beforehand, and only the copy with the least id takes part. Hot names
and windows are pre-aggregated; the joins back are plain shuffles that adaptive execution may split.

Defined results: null and empty texts have no words. A null ``doc_id`` neither loses words nor makes others
lose any. Rows that repeat, or share a ``doc_id``, are treated alike: an equal id is not smaller. Empty tables
give no rows. Other columns are carried and may have any name. Texts are read whole, however long.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import byte_slices, drop_staged, stage, tidy

WINDOW = 50
ROUNDS = ("run", "pair", "pair", "run", "pair", "pair", "pair", "pair", "pair")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash, a bijection."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix(mix(a + U((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)) * U(3) + b)


def name_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], U)


class Sequence:
    """Symbols of several documents end to end: names, the words they stand for, and the words that their
    making depended on (beyond the document's ends where it depended on those)."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.names = np.concatenate([*docs, np.zeros(0, U)])
        self.doc = np.repeat(np.arange(len(docs)), sizes)
        self.lo = np.arange(len(self.names))
        self.hi = self.lo + 1

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a symbol would depend on through its left and its right neighbour: [lo, hi) of each, or a
        word beyond the end."""
        n = len(self.names)
        inner = self.doc[1:] == self.doc[:-1]
        first, last = np.append(True, ~inner)[:n], np.append(~inner, True)[:n]
        left_lo, left_hi = np.roll(self.lo, 1), np.roll(self.hi, 1)
        right_lo, right_hi = np.roll(self.lo, -1), np.roll(self.hi, -1)
        left_lo[first], left_hi[first] = self.starts[self.doc[first]] - 1, self.lo[first]
        right_lo[last], right_hi[last] = self.lo[last], self.ends[self.doc[last]] + 1
        return left_lo, left_hi, right_lo, right_hi

    def take(self, first: np.ndarray, names: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.names, self.doc, self.lo, self.hi = names, self.doc[first], lo, hi

    def runs(self, salt: int) -> None:
        n = len(self.names)
        if not n:
            return
        head = np.append(True, (self.names[1:] != self.names[:-1]) | (self.doc[1:] != self.doc[:-1]))
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, n))
        # that the run ends where it does depends on both neighbours
        left_lo, left_hi, right_lo, right_hi = self.neighbours()
        lo = np.minimum.reduceat(np.minimum(self.lo, np.minimum(left_lo, right_lo)), first)
        hi = np.maximum.reduceat(np.maximum(self.hi, np.maximum(left_hi, right_hi)), first)
        names = self.names[first]
        names = np.where(size > 1, join(names, size.astype(U), salt), names)
        self.take(first, names, lo, hi)

    def pairs(self, salt: int) -> None:
        n = len(self.names)
        if not n:
            return
        right = (mix(self.names + U(salt * 2 + 1)) >> U(17)) & U(1) == U(1)
        meet = np.append(~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1]), False)
        taken = np.append(False, meet[:-1])
        left_lo, left_hi, right_lo, right_hi = self.neighbours()
        # a pair depends on its two parts; a left symbol alone on its right neighbour, and vice versa
        alone = right & ~taken
        lo = np.minimum(self.lo, np.where(alone, left_lo, right_lo))
        hi = np.maximum(self.hi, np.where(alone, left_hi, right_hi))
        names = np.where(meet, join(self.names, np.roll(self.names, -1), salt), self.names)
        keep = np.flatnonzero(~taken)
        self.take(keep, names[keep], lo[keep], hi[keep])

    def windows(self, size: int) -> np.ndarray:
        """The first word of every window."""
        counts = np.maximum(self.ends - self.starts - size + 1, 0)
        at = np.cumsum(counts) - counts
        return np.repeat(self.starts - at, counts) + np.arange(counts.sum())


def compress(docs: list[np.ndarray]) -> Sequence:
    seq = Sequence(docs)
    for k, kind in enumerate(ROUNDS):
        (seq.runs if kind == "run" else seq.pairs)(k + 1)
    return seq


def window_names(names: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Names of the windows that start at ``at``, put together of names of 1, 2, 4, ... words."""
    if not len(at):
        return np.zeros(0, U)
    level, width, done, out = mix(names ^ U(salt)), 1, 0, None
    while done < size:
        if size & width:
            part = level[at + done]
            out = part if out is None else join(out, part, salt)
            done += width
        if done < size:
            level = join(level[:-width], level[width:], salt) if len(level) > width else level[:0]
            width *= 2
            level = np.append(level, np.zeros(len(names) - len(level), U))
    return out


class Parsed:
    """Documents with their high-level symbols and the windows that contain the making of each."""

    def __init__(self, docs: list[np.ndarray], size: int):
        self.seq = compress(docs)
        self.flat = np.concatenate([*docs, np.zeros(0, U)])
        self.at = self.seq.windows(size)
        self.of = np.searchsorted(self.seq.ends, self.at, "right") if len(self.at) else self.at
        s = self.seq
        # symbol k lies in the windows that start from hi - size to lo, if the document has them
        a = np.maximum(s.hi - size, s.starts[s.doc]) if len(s.names) else s.hi
        b = np.minimum(s.lo, s.ends[s.doc] - size) if len(s.names) else s.lo
        use = np.flatnonzero(a <= b)
        self.names, self.doc = s.names[use], s.doc[use]
        # as positions in ``at``, which has every start in order
        self.first, self.last = np.searchsorted(self.at, a[use]), np.searchsorted(self.at, b[use])
        self.bare = np.flatnonzero(self.count(np.ones(len(use), np.int64)) == 0)
        self.bare_names = window_names(self.flat, self.at[self.bare], size, 5)
        self.size = size

    def count(self, weight: np.ndarray) -> np.ndarray:
        """For each window, the sum over its symbols."""
        total = np.zeros(len(self.at) + 1, np.int64)
        np.add.at(total, self.first, weight)
        np.add.at(total, self.last + 1, -weight)
        return np.cumsum(total)[:-1]

    def all_names(self) -> list[np.ndarray]:
        """What each document hands in, each name once."""
        names, doc = np.append(self.names, self.bare_names), np.append(self.doc, self.of[self.bare])
        return _by_doc(names, doc, len(self.seq.starts))

    def candidates(self, shared: list[np.ndarray]) -> np.ndarray:
        """Positions in ``at`` of the windows whose symbols are all shared."""
        order = [np.sort(x) for x in shared]
        lost = ~_member(self.names, self.doc, order)
        ok = self.count(lost.astype(np.int64)) == 0
        ok[self.bare] = _member(self.bare_names, self.of[self.bare], order)
        return np.flatnonzero(ok)


def _member(names: np.ndarray, doc: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(names), bool)
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(len(sets) + 1))
    for k, s in enumerate(sets):
        own = order[bounds[k] : bounds[k + 1]]
        if len(s) and len(own):
            at = np.minimum(np.searchsorted(s, names[own]), len(s) - 1)
            out[own] = s[at] == names[own]
    return out


def _by_doc(names: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    new = np.append(True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])) if len(names) else np.zeros(0, bool)
    names, doc = names[new], doc[new]
    return np.split(names, np.searchsorted(doc, np.arange(1, n)))


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _longs(arrays) -> pa.Array:
    """A list<long> column of arrays of unsigned names."""
    sizes = [len(x) for x in arrays]
    flat = np.concatenate([*arrays, np.zeros(0, U)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))


def _names_of(column) -> list[np.ndarray]:
    return [np.zeros(0, U) if x is None else np.array(x, np.int64).view(U) for x in column.to_pylist()]


def handed_in(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, names) of (doc_id, digest, text)."""

    def run(batches):
        for part in (p for b in batches for p in byte_slices(b, 2)):
            parsed = Parsed([name_words(_words(t)) for t in part.column(2).to_pylist()], window)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _longs(parsed.all_names())], names=["doc_id", "digest", "names"])

    return docs.mapInArrow(tidy(run), T.StructType([docs.schema["doc_id"], docs.schema["digest"], T.StructField("names", T.ArrayType(T.LongType()))]))


def candidate_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, a, b): the names of the windows of (doc_id, text, names) that may occur elsewhere, each once."""

    def run(batches):
        for part in (p for b in batches for p in byte_slices(b, 1)):
            words = [name_words(_words(t)) for t in part.column(1).to_pylist()]
            parsed = Parsed(words, window)
            k = parsed.candidates(_names_of(part.column(2)))
            a, b = (window_names(parsed.flat, parsed.at[k], window, salt) for salt in (5, 6))
            of = parsed.of[k]
            order = np.lexsort((b, a, of))
            a, b, of = a[order], b[order], of[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])) if len(a) else np.zeros(0, bool)
            ids = part.column(0).take(pa.array(of[new]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64))], names=["doc_id", "a", "b"])

    return docs.mapInArrow(tidy(run), T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in "ab"]]))


def shared_only(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key occurs with two ids or more, with the least id as ``least``."""
    least = rows.groupBy(*key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = stage(least.filter("least < most").drop("most"), "shared")
    return rows.join(least, key)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, copy, windows): for documents that lose words, whether they are exact copies of one with a
    smaller id, or else the names of the windows that also start in such a one."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    names = stage(handed_in(rows, window), "names")
    digest = names.select("doc_id", "digest").distinct()
    first = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stage(digest.join(first.drop("n"), "digest").filter("doc_id > least").select("doc_id", "digest"), "copies")
    # texts are not moved for this: their names are, and a text is only read again if it has shared ones
    each = names.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "digest", F.explode("names").alias("name"))
    shared = shared_only(each, ["name"]).groupBy("doc_id", "digest").agg(F.collect_set("name").alias("names"))
    shared = stage(shared, "shared_names")
    drop_staged(names)
    found = stage(candidate_windows(rows.join(shared, ["doc_id", "digest"]).select("doc_id", "text", "names"), window), "windows")
    drop_staged(shared)
    lost = shared_only(found, ["a", "b"]).filter("doc_id > least").groupBy("doc_id").agg(F.collect_set("a").alias("windows"))
    lost = stage(lost, "lost_windows")
    drop_staged(found)
    return lost.join(copies, "doc_id", "full").select("doc_id", F.col("digest").alias("copy"), "windows")


def kept_words(words: list[bytes], names: np.ndarray | None, copy: bool, window: int) -> list[bytes]:
    """Without the words that the given windows cover; a copy loses all windows."""
    if len(words) < window or not (copy or names is not None and len(names)):
        return words
    if copy:
        return []
    own = name_words(words)
    at = np.arange(len(words) - window + 1)
    hit = np.isin(window_names(own, at, window, 5), names)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:-window] += hit
    edge[window:] -= hit
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone) if not g]


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` as a column ``doc``, with ``n_words``, ``n_removed`` and ``kept``: the words that stay, joined
    by one space."""
    lost = stage(repeats(docs, window), "lost")
    doc = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"),
    )
    # a row per document and digest on the right: windows belong to the document, a copy to its digest
    windows = lost.filter("windows IS NOT NULL").groupBy("doc_id").agg(F.first("windows").alias("windows"))
    copies = lost.filter("copy IS NOT NULL").groupBy("doc_id").agg(F.collect_set("copy").alias("copies"))
    marks = stage(windows.join(copies, "doc_id", "full"), "marks")
    rows = doc.join(marks, F.col("doc.doc_id") == marks["doc_id"], "left").select(
        "doc", F.col("doc.text").cast("string").alias("text"), F.coalesce(F.array_contains("copies", F.col("digest")), F.lit(False)).alias("copy"), "windows"
    )

    def run(batches):
        for part in (p for b in batches for p in byte_slices(b, 1)):
            n, m, kept = [], [], []
            for text, copy, names in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), _names_of(part.column(3))):
                words = _words(text)
                left = kept_words(words, names, copy, window)
                n.append(len(words))
                m.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string())],
                names=["doc", "n_words", "n_removed", "kept"],
            )

    out = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return rows.mapInArrow(tidy(run), T.StructType([rows.schema["doc"], *out]))
