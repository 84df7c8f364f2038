"""Byte-pair encoding by a tokenization automaton, and decoding.

The merges are compiled, in their order, into a deterministic automaton whose arcs are labelled with
tokens and which reads exactly the correct tokenizations (the merge gadget of Berglund, Martens and van
der Merwe, "Constructing a BPE Tokenization DFA", 2024). It starts with one state and a loop for each
byte. The gadget of merge u+v splits the state that u leads to: u now leads to a copy without
the arc v, and wherever u could be read, an arc uv leads to where v led. All arcs of a label lead to the
same state, so the transitions are a table of bits, states by classes of labels: labels that the same states
read share a class, states and classes are copied when a gadget sets one of those that share them apart. The
vocabulary of 50,000 merges makes 14,638 states and 10,604 classes, 19 MB, on the driver; tasks get the table.

A pre-split word is encoded by the one path of the automaton that spells it: of the labels that the word goes on
with, the longest that has an arc; where none has, the position is not on the path and the step before it is
taken again. Decoding emits the labels of the arcs.

Defined results: a null or empty text gives no ids. Strings of special tokens in a text become their
ids, as in the tokenizers library. Texts are read whole. Row order and repeated rows are kept, empty
tables give no rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers.pre_tokenizers import ByteLevel

from ._io import byte_slices, tidy

#: Fixed value: the pre-splitting pattern of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the regex module classes as the tokenizers library does, whatever their versions of
#: Unicode: blocks that were full long ago. Texts with others are split by that library.
OTHERS = regex.compile(r"[^\x00-\x1b\x20-\u052f\u2000-\u205e\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]").search

#: Characters that are a word of their own after letters.
MARKS = ".,;:!?"
#: Entries that a worker remembers before it forgets them all.
CACHE = 200_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself, or the next from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """``label[id]``: a token's bytes; ``special``: strings that are tokens as they stand; ``state[id]``: where the arcs
    of a label lead; ``kind[id]``: its class; ``table``: for each state, a bit for each class that it has arcs of."""

    def __init__(self, text: str):
        """``text``: the JSON of a tokenizer of the tokenizers library."""
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.label = [b""] * self.size
        self.ids: dict[bytes, int] = {}
        for s, k in self.special.items():
            self.label[k] = s.encode()
        for s, k in model["vocab"].items():
            if s not in self.special:
                self.label[k] = raw(s)
                self.ids[raw(s)] = k
        #: for three bytes, how long a label that begins with them can be
        self.reach: dict[bytes, int] = {}
        for x in self.ids:
            if len(x) > 2:
                self.reach[x[:3]] = max(len(x), self.reach.get(x[:3], 0))
        merges = []
        for pair in model["merges"]:
            u, v = (self.ids[raw(s)] for s in (pair.split(" ") if isinstance(pair, str) else pair))
            merges.append((u, v, self.ids[self.label[u] + self.label[v]]))
        self._build(merges)

    def _build(self, merges: list[tuple[int, int, int]]) -> None:
        """State 0 is the start and class 0 has no arcs; at first all bytes lead to state 0 and are of class 1."""
        single = [k for x, k in self.ids.items() if len(x) == 1]
        state, kind = [-1] * self.size, [0] * self.size
        for k in single:
            state[k], kind[k] = 0, 1
        sharing = [{0: 1 + len(single)}, {1: len(single)}]  # how many labels (and the start) a state or class has
        rows = 1 + len(merges)
        table = np.zeros((256, rows // 8 + 1), np.uint8)
        table[0, 0] = 2
        states, classes = 1, 2
        for u, v, uv in merges:
            if state[u] < 0 or state[v] < 0 or not table[state[u], kind[v] >> 3] >> (kind[v] & 7) & 1:
                continue  # never applied: an earlier merge takes one of the two
            if state[uv] >= 0:
                raise ValueError(f"two merges make {self.label[uv]!r}")
            state[uv] = state[v]
            sharing[0][state[v]] += 1
            if sharing[0][state[u]] > 1:  # the gadget's copy
                if states == len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[states] = table[state[u]]
                sharing[0][state[u]] -= 1
                state[u], sharing[0][states] = states, 1
                states += 1
            if sharing[1][kind[v]] > 1:
                old, new = kind[v], classes
                table[:states, new >> 3] |= (table[:states, old >> 3] >> (old & 7) & 1) << (new & 7)
                sharing[1][old] -= 1
                kind[v], sharing[1][new] = new, 1
                classes += 1
            table[state[u], kind[v] >> 3] &= 255 ^ 1 << (kind[v] & 7)
            kind[uv] = kind[u]
            sharing[1][kind[u]] += 1
        self.states, self.classes, self.width = states, classes, (classes >> 3) + 1
        self.table = table[:states, : self.width].tobytes()
        self.state, self.kind = state, kind

    def arc(self, state: int, x: int) -> bool:
        """Whether the state has an arc of label x."""
        c = self.kind[x]
        return bool(self.table[state * self.width + (c >> 3)] >> (c & 7) & 1)

    def word(self, raw: bytes) -> tuple[int, ...]:
        """The ids of a pre-split word."""
        get, table, width, kind, state = self.ids.get, self.table, self.width, self.kind, self.state
        n, reach, at, base = len(raw), self.reach.get, 0, 0
        out, begun, off = [], [], set()
        while at < n:
            for end in range(min(n, at + reach(raw[at : at + 3], 2)), at, -1):
                x = get(raw[at:end])
                if x is not None and end not in off:
                    c = kind[x]
                    if table[base + (c >> 3)] >> (c & 7) & 1:
                        out.append(x)
                        begun.append(at)
                        at, base = end, state[x] * width
                        break
            else:  # all that is read so far is the one path to this position, so it is not on the word's path
                off.add(at)
                out.pop()
                at = begun.pop()
                base = state[out[-1]] * width if out else 0
        return tuple(out)


class Encoder:
    """Whole texts: special tokens, pre-splitting, words; what has been seen is remembered."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.by_pattern = regex.compile(PATTERN).findall
        self.by_library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces = _Pieces(self)
        self.strings = [str(k) for k in range(automaton.size)]
        special = sorted(automaton.special, key=len, reverse=True)
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def split(self, text: str) -> list[str]:
        if OTHERS(text):
            return [text[s:e] for _, (s, e) in self.by_library(text)]
        return self.by_pattern(text)

    def forget(self) -> None:
        """Drops what was remembered; a worker that waits for its next task should not hold it."""
        self.known.clear()
        self.pieces.clear()

    def word(self, w: str) -> tuple[int, ...]:
        ids = self.known.get(w)
        if ids is None:
            if len(self.known) > CACHE:
                self.known.clear()
            ids = self.known[w] = self.automaton.word(w.encode())
        return ids

    def plain(self, text: str) -> list[int]:
        """A text without special tokens. Where single blanks stand between other characters, words
        never reach across them, so the pieces between them are looked up as they are."""
        first, *rest = text.split(" ")
        found = self.pieces
        if first and not first[-1].isspace():
            try:
                return [*chain(self.words(first), chain.from_iterable(map(found.__getitem__, rest)))]
            except Odd:
                pass
        return self.words(text)

    def words(self, text: str) -> list[int]:
        return [*chain.from_iterable(map(self.word, self.split(text)))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        special = self.automaton.special
        if any(s in text for s in special):
            out = []
            for k, part in enumerate(self.by_special(text)):
                out += [special[part]] if k % 2 else self.plain(part) if part else []
            return out
        return self.plain(text)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.automaton.label.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


class Odd(Exception):
    """White space beside a blank: the text has to be split as a whole."""


class _Pieces(dict):
    """Ids of a blank and the piece that follows it."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Odd
        if len(self) > CACHE:
            self.clear()
        known = piece.isascii() or not OTHERS(piece)
        if known and piece.isalpha():  # one word
            ids = self.encoder.automaton.word((" " + piece).encode())
        elif known and piece[-1] in MARKS and piece[:-1].isalpha():
            ids = (*self[piece[:-1]], *self.encoder.word(piece[-1]))
        else:
            ids = tuple(self.encoder.words(" " + piece))
        self[piece] = ids
        return ids


_encoders: dict[str, Encoder] = {}
_automata: dict[str, MergeAutomaton] = {}


def automaton(path: str | None = None) -> tuple[str, MergeAutomaton]:
    """The automaton of a tokenizer's file and its key, compiled once on the driver. Its size is the vocabulary's."""
    with open(path or default_path(), encoding="utf-8") as file:
        text = file.read()
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = MergeAutomaton(text)
    return key, _automata[key]


def encoder(made: tuple[str, MergeAutomaton]) -> Encoder:
    """A worker's encoder."""
    key, found = made
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(found)
    return _encoders[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def map_texts(docs: DataFrame, schema: str, f: Callable, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key`` and what ``f(encoder, text)`` returns, a tuple for the columns of ``schema``. The automaton is broadcast."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(automaton(path))
    docs = docs.select(key, F.col("text").cast("string").alias("text"))
    out = T.StructType.fromDDL(schema)
    arrow = [x.type for x in to_arrow_schema(out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        try:
            for batch in batches:
                for part in byte_slices(batch, 1):
                    got = zip(*[f(enc, t) for t in part.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *[pa.array(x, type=t) for x, t in zip(got, arrow)]], names=[key, *out.names]
                    )
        finally:
            enc.forget()

    return docs.mapInArrow(tidy(run), T.StructType([docs.schema[key], *out.fields]))


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, ids): the ids of every whole text."""
    return map_texts(docs, "ids array<int>", lambda enc, text: (enc.encode(text),), path, key)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids)."""
    spark: SparkSession = encoded.sparkSession
    shared = spark.sparkContext.broadcast(automaton(path))
    encoded = encoded.select(key, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            texts = [enc.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[key, "text"])

    return encoded.mapInArrow(tidy(run), T.StructType([encoded.schema[key], T.StructField("text", T.StringType())]))
