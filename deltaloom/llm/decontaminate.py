"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words (A-Z lower-cased, runs of letters, digits and non-ASCII characters) go
into one suffix automaton. Each document's words are streamed through it; after every word the state
tells the longest suffix read so far that occurs in an item. A match of ``window`` words or more is an
occurrence of a window; an item of fewer words is a window as a whole.

The automaton is built on the driver and broadcast only up to ``MAX_WORDS`` item words; larger item
sets are split by item into blocks of that size, which take one pass over the documents each, so the
result is the same at any size.

Defined results: a null or empty text has no words and no hits; so has an item. Items that repeat, or
share an id, count once by id; a null id counts as the id ''. Empty tables give no hits or no rows.
Other columns are carried along and may have any name. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import byte_slices, stage, tidy

WINDOW = 10
MAX_WORDS = 4_000_000

#: Every byte that is no word character becomes a blank; A-Z become a-z. Bytes of 128 and more are
#: parts of non-ASCII characters, which are word characters.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


class SuffixAutomaton:
    """All substrings, in words, of the items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window = window
        self.names = sorted({name for name, _ in items})
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        number = {name: k for k, name in enumerate(self.names)}
        texts = []
        for name, text in items:
            if ws := words(text):
                texts.append((number[name], [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]))
        for _, ids in texts:
            state = 0
            for c in ids:
                state = self._extend(state, c)
        self._mark(texts)

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string and c: c's target, or a clone of it if that is longer."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = self._split(p, c) if p >= 0 else 0
        return new

    def _mark(self, texts: list[tuple[int, list[int]]]) -> None:
        """Which items own the windows that end in a state."""
        n, w = len(self.next), self.window
        order = sorted(range(n), key=self.length.__getitem__)
        #: for states of w words and more, the state of their last w words
        self.cut = [-1] * n
        for v in order[1:]:
            if self.length[v] >= w:
                p = self.link[v]
                self.cut[v] = self.cut[p] if self.length[p] >= w else v
        self.owners: dict[int, set[int]] = {}
        whole: dict[int, dict[int, set[int]]] = {}
        for k, ids in texts:
            state = 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i >= w - 1:
                    self.owners.setdefault(self.cut[state], set()).add(k)
            if len(ids) < w:
                while self.length[self.link[state]] >= len(ids):
                    state = self.link[state]
                whole.setdefault(state, {}).setdefault(len(ids), set()).add(k)
        #: short items by state, as (words, items): those of the state itself, whose length must be
        #: compared with the match, and those of the states above it, which are always matched
        self.own = {v: sorted((m, frozenset(x)) for m, x in by.items()) for v, by in whole.items()}
        self.above: list[tuple[int, frozenset[int]]] = [(0, frozenset())] * n
        for v in order[1:]:
            p = self.link[v]
            m, x = self.above[p]
            for length, more in self.own.get(p, ()):
                m, x = max(m, length), x | more
            self.above[v] = (m, x)

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The disjoint spans of words (end exclusive) that occurrences of windows cover, in order,
        and the items those windows come from."""
        get, follow, link, length = self.vocabulary.get, self.next, self.link, self.length
        cut, owners, own, above, w = self.cut, self.owners, self.own, self.above, self.window
        short = bool(own)
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        state = matched = 0
        for i, c in enumerate(map(get, ws)):
            if c is None:
                state = matched = 0
                continue
            to = follow[state].get(c)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = follow[state].get(c)
                matched = length[state]
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= w:
                found.append((i + 1 - w, i + 1))
                items |= owners[cut[state]]
            if short:
                m, x = above[state]
                for k, more in own.get(state, ()):
                    if k <= matched:
                        m, x = max(m, k), x | more
                if m:
                    items |= x
                    if matched < w:
                        found.append((i + 1 - m, i + 1))
        return merge(found), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
ARROW_FOUND = [pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]


def automata(benchmark: DataFrame, window: int, max_words: int) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items; a block's items have about ``max_words`` words at most
    (each item lies in one block, however long)."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = benchmark.select(name.alias("name"), F.col("text").cast("string").alias("text"))
    # an upper bound of the words: every word but the last is followed by another character
    bound = items.select(F.sum(F.length("text") + 1).cast("long")).first()[0] or 0
    blocks = 1 + bound // (2 * max_words)
    for k in range(blocks):
        some = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k)
        yield SuffixAutomaton([tuple(r) for r in some.distinct().toLocalIterator()], window)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` as a column ``doc`` (struct of all its columns), with ``n_words``, ``spans`` (the hit
    words, as [start, end) in words) and ``items`` (the ids of the items, sorted as strings)."""
    spark = docs.sparkSession
    empty = F.array().cast(FOUND["spans"].dataType), F.array().cast(FOUND["items"].dataType)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.lit(0).cast("long").alias("n_words"),
        empty[0].alias("spans"),
        empty[1].alias("items"),
    )
    for k, automaton in enumerate(automata(benchmark, window, max_words)):
        if k:
            rows = stage(rows, "hits")  # one automaton in memory at a time
        shared = spark.sparkContext.broadcast(automaton)

        def search(batches, shared=shared):
            auto = shared.value
            for batch in batches:
                for part in byte_slices(batch, 0):
                    n, spans, items = [], [], []
                    texts = part.column(0).field("text").to_pylist()
                    for text, old, was in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                        ws = words(text)
                        hit, owners = auto.match(ws)
                        n.append(len(ws))
                        spans.append(merge([*map(tuple, old), *hit]) if old else hit)
                        items.append(sorted({*was, *(auto.names[k] for k in owners)}))
                    new = [pa.array(x, type=t) for x, t in zip((n, [[list(s) for s in x] for x in spans], items), ARROW_FOUND)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *new], names=part.schema.names)

        rows = rows.mapInArrow(tidy(search), rows.schema)
    return rows


def covered(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def cut_spans(text: str, spans: list[list[int]]) -> str:
    """``text`` without the given spans of words, each from its first to its last character."""
    raw, normal = text.encode(), text.encode().translate(NORMAL)
    starts, ends, k = [], [], 0
    for w in normal.split():
        k = normal.index(w, k)
        starts.append(k)
        k += len(w)
        ends.append(k)
    kept, at = [], 0
    for s, e in spans:
        kept.append(raw[at : starts[s]])
        at = ends[e - 1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, **limits
) -> DataFrame:
    """``docs`` without the spans that occur in the items; a document of whose words more than
    ``max_coverage`` are hit goes altogether. ``n_chars``, if it is a column, is counted anew for the
    texts that change. Documents without a hit are returned as they are."""
    found = find(docs, benchmark, window, **limits)
    found = found.filter(covered(F.col("spans")) <= F.col("n_words") * max_coverage)

    @F.pandas_udf("string")
    def without(text, spans):
        return text.combine(spans, lambda t, s: cut_spans(t, s) if t and len(s) else t)

    found = found.withColumn("text", F.when(F.size("spans") > 0, without(F.col("doc.text"), "spans")).otherwise(F.col("doc.text")))
    columns = []
    for f in docs.schema.fields:
        old = F.col("doc")[f.name]
        if f.name == "text":
            old = F.col("text")
        elif f.name == "n_chars":
            old = F.when(F.size("spans") > 0, F.length("text")).otherwise(old).cast(f.dataType)
        columns.append(old.alias(f.name))
    return found.select(*columns)
