"""Token-id files, compressed by Re-Pair grammars, with random access.

Texts are encoded by the tokenizers library, its model given each distinct word of some texts once, and an end id is appended to each document. The documents are
dealt by ranges of ``doc_id``, and each task writes its documents, in order, as shards of about
``SHARD`` ids. In a shard, Re-Pair counts all pairs of neighbouring symbols exactly and replaces the frequent ones by
nonterminals: a round takes all that occur at least an eighth as often as the most frequent one, and rounds go on
until no pair pays, which a rule of 12 bytes does from ``LEAST`` occurrences on. There is no limit to the rules. A shard is one binary value of the format below, a row of a Parquet table in a folder that
all executors share, so any store that Spark writes to will do.

Format (little endian), version 2; a symbol is a place in the alphabet, or beyond it a rule::

    4s   magic "RPT2"          u32  bytes of a symbol (2 or 4)     u32  ids of the alphabet
    u32  rounds                u32  rules                          u32  documents
    u64  symbols               u64  ids
    u32  for each round, its first rule
    u32  the alphabet: the ids that occur in the shard, ascending
    u32  for each rule, its left and its right symbol
    u32  for each rule, how many ids it expands to
    u64  for each document, its number of ids (with the end id)
    u64  for every 1,024th symbol, the ids before it
    the symbols

:func:`read_range` decodes a range of ids from the symbols that cover it and nothing else.

Defined results: a null or empty text is the end id alone. Null ids come first; rows that share a
``doc_id`` follow each other in the order in which the table is read. Strings of special tokens in a text
become their ids. Other columns are ignored; an empty table makes no shards. Texts are read whole; a shard
ends with the document that fills it, so a very long document makes a longer shard.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._io import byte_slices, stage, tidy
from .bpe import OTHERS, byte_alphabet, default_path

SHARD = 800_000
LEAST = 7
STEP = 1024
HEAD = struct.Struct("<4sIIIIIQQ")
#: Bytes that remembered pieces may take, by estimate.
CACHE = 256 << 20

#: Bytes of texts that are encoded at once.
SLICE = 8 << 20
#: Words that the model is given at once: its merges of a longer string take longer each.
TOGETHER = 16
#: Bytes that never occur in UTF-8.
NEVER = (0xC0, 0xC1, *range(0xF5, 0x100))
#: Classes of characters: those of :data:`OTHERS` have none.
LETTER, NUMBER, SIGN, BLANK, SPACE = range(1, 6)


def classes() -> np.ndarray:
    """The class of every character, by code point."""
    out = np.zeros(0x110000, np.uint8)
    text = "".join([c for c in map(chr, range(0xD800)) if not OTHERS(c)])
    of = lambda part: np.array([*map(ord, part)], np.int64)
    out[of(text)] = SIGN
    for name, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[of(regex.findall(pattern, text))] = name
    out[0x20] = BLANK
    return out


def spread(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` values of ``flat`` from ``first`` on, for each of these."""
    end = np.cumsum(n)
    if not len(end) or not end[-1]:
        return flat[:0]
    at = np.repeat((first - end + n).astype(np.int32 if max(len(flat), end[-1]) < 2**31 else np.int64), n)
    at += np.arange(end[-1], dtype=at.dtype)
    return flat[at]


class LibraryEncoder:
    """Ids by the tokenizers library. Where single blanks stand between other characters no token reaches
    across, so what follows a blank is encoded once. These pieces are split into words by classes of characters, as the
    vocabulary's pattern does, and the library's model encodes each distinct word. Pieces with characters of no class, texts'
    first pieces, and all pieces of other kinds of tokenizers are given to the library as they are and remembered."""

    def __init__(self, text: str):
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model.tokenize
        spec = json.loads(text)
        own = spec.get("pre_tokenizer") or {}
        letter = {b: c for c, b in byte_alphabet().items()}
        #: the characters that stand for bytes
        self.letters = np.array([ord(letter[b]) for b in range(256)], "<u4")
        merges = spec["model"].get("merges", ())
        used = set("".join([x if isinstance(x, str) else "".join(x) for x in merges]))
        #: the token of a byte that UTF-8 does not have and no merge knows
        self.between = next((letter[b] for b in NEVER if letter[b] not in used and self.tokenizer.token_to_id(letter[b]) is not None), None)
        self.between_id = self.between and self.tokenizer.token_to_id(self.between)
        #: whether words are split as the pattern says, nothing else is done to a text, and many can be told apart in one string
        self.plain = own.get("type") == "ByteLevel" and own.get("use_regex", True) and not own.get("add_prefix_space") and spec.get("normalizer") is None
        self.plain = self.plain and self.between is not None
        if self.plain:
            self.of_class = classes()
        self.known: dict[str, bytes] = {}
        self.held = 0

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def remembered(self, texts: list[str]) -> list[bytes]:
        """The ids of pieces, by the library."""
        out = [*map(self.known.get, texts)]
        for k, x in enumerate(out):
            if x is None:
                out[k] = self.known[texts[k]] = self.library(texts[k]).tobytes()
                self.held += 4 * len(texts[k]) + len(out[k]) + 220
        return out

    def words(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, which are bytes of ``raw``, end to end, and how many each word has. The model is given many at
        once, with a symbol between them that no merge knows, so that it cannot join what is beside it."""
        spelt = spread(self.letters[np.append(raw, raw[:1])], start, size + 1)
        end = np.cumsum(size + 1)
        spelt[end - 1] = ord(self.between)
        text, get_id = spelt.tobytes().decode("utf-32-le"), attrgetter("id")
        ends = [*end[TOGETHER - 1 :: TOGETHER].tolist(), len(text)]
        ids = array("I")
        for a, b in zip([0, *ends], ends):
            ids.extend(map(get_id, self.model(text[a:b])))
        ids = np.frombuffer(ids, np.uint32)
        inside = ids != self.between_id
        return ids[inside], np.diff(np.flatnonzero(~inside), prepend=-1) - 1

    def split(self, raw: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of ``text``, which is ``raw``, begin; for each piece, its first word and whether it is to be left
        to the library, or the whole text is. A piece is a blank and what follows it."""
        if len(raw) == len(text):
            code, at = raw, None
        else:
            code, at = np.frombuffer(text.encode("utf-32-le"), "<u4"), np.flatnonzero(raw & 0xC0 != 0x80)
        kind = self.of_class[code]
        blank = kind == BLANK
        cut = blank.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & ~blank[:-1]
        space = np.flatnonzero(kind == SPACE)
        # the last of several is a word of its own
        space = space[(space > 0) & (space < len(kind) - 1)]
        cut[space[(kind[space - 1] == SPACE) & (kind[space + 1] != SPACE)]] = True
        mark = np.flatnonzero(code == ord("'"))
        mark = mark[(kind[mark - 1] != SIGN) & (kind[mark - 1] != BLANK)]
        last = len(code) - 1
        one, two = code[np.minimum(mark + 1, last)], code[np.minimum(mark + 2, last)]
        short = np.isin(one, [*b"sdmt"])
        long = (one == ord("l")) & (two == ord("l")) | ((one == ord("v")) | (one == ord("r"))) & (two == ord("e"))
        for shortened, n in ((mark[short], 2), (mark[long], 3)):
            cut[shortened + 1] = False
            end = shortened + n
            cut[end[end <= last]] = True
        begin = np.flatnonzero(cut)
        piece = np.flatnonzero(blank)
        first = np.searchsorted(begin, piece)
        # nothing between blanks, or white space beside one
        end = np.append(piece[1:], len(kind)) - 1
        odd = (end == piece) | (kind[end] == SPACE) | (kind[np.minimum(piece + 1, last)] == SPACE)
        begin = begin if at is None else at[begin]
        return begin, first, np.minimum.reduceat(kind, piece) == 0, odd

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, without their blanks, end to end, how many each has, and whether its text has to be left to the library."""
        # no piece holds a blank, so that all are had as one string
        every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        text = " " + pc.binary_join(every, " ")[0].as_py()
        if not self.plain:
            lone = text[1:].split(" ")
            odd = np.array([not p or p[0].isspace() or p[-1].isspace() for p in lone])
            found = self.remembered([" " + p for p, x in zip(lone, odd.tolist()) if not x])
            size = np.zeros(len(lone), np.int64)
            size[~odd] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            return np.frombuffer(b"".join(found), "<u4"), size, odd
        coded = text.encode()
        raw = np.frombuffer(coded, np.uint8)
        begin, first, hard, odd = self.split(raw, text)
        # equal words once
        same = np.append(begin, len(raw)).astype(np.int32)
        same = pa.StringArray.from_buffers(len(begin), pa.py_buffer(same), pa.py_buffer(coded)).dictionary_encode()
        which, (_, ends, own) = same.indices.to_numpy(), same.dictionary.buffers()
        ends = np.frombuffer(ends, np.int32, len(same.dictionary) + 1)
        # characters of no class may be white space as well
        place, hard = np.append(begin[first], len(raw)), np.flatnonzero(hard & ~odd)
        lone = [coded[place[k] : place[k + 1]].decode() for k in hard.tolist()]
        beside = np.array([p[1].isspace() or p[-1].isspace() for p in lone], bool)
        odd[hard[beside]] = True
        left = odd.copy()
        left[hard] = True
        wanted = np.repeat(~left, np.diff(np.append(first, len(begin))))
        need = np.zeros(len(same.dictionary), bool)
        need[which[wanted]] = True
        flat, n = np.zeros(0, np.uint32), np.zeros(len(need), np.int64)
        if need.any():
            flat, n[need] = self.words(np.frombuffer(own, np.uint8, ends[-1]), ends[:-1][need], np.diff(ends)[need])
        count = np.where(wanted, n[which], 0)
        flat, size = spread(flat, (np.cumsum(n) - n)[which], count), np.add.reduceat(count, first)
        hard = hard[~beside]
        if len(hard):
            found = self.remembered([p for p, x in zip(lone, beside.tolist()) if not x])
            start = np.cumsum(size) - size
            size[hard] = np.fromiter(map(len, found), np.int64, len(found)) // 4
            start[hard] = len(flat) + np.cumsum(size[hard]) - size[hard]
            flat = spread(np.concatenate([flat, np.frombuffer(b"".join(found), "<u4")]), start, size)
        return flat, size, odd

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text. Arrow splits the texts and tells the distinct pieces, which are encoded once each; NumPy
        puts their ids in the pieces' places."""
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        start = split.offsets.to_numpy().astype(np.int64)
        pieces = split.values.slice(start[0], start[-1] - start[0]).dictionary_encode()
        start, which = start - start[0], pieces.indices.to_numpy()
        # a text's first piece follows no blank
        later = np.ones(len(which), bool)
        later[start[:-1]] = False
        used = np.zeros(len(pieces.dictionary), bool)
        used[which[later]] = True
        size, odd = np.zeros(len(used), np.int32), np.zeros(len(used), bool)
        flat = np.zeros(0, np.uint32)
        if used.any():
            flat, size[used], odd[used] = self.pieces(pieces.dictionary.filter(pa.array(used)))
        first = (np.cumsum(size) - size).astype(np.int32)
        # white space beside a blank, or the string of a special token, leaves a text to the library
        whole = np.add.reduceat(odd[which] & later, start[:-1]) > 0
        for name in self.special:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        n = size[which]
        n[start[:-1]] = 0
        n[np.repeat(whole, np.diff(start))] = 0
        ids = spread(flat, first[which], n)
        ends = np.cumsum(n)[start[1:] - 1].tolist()
        heads = pieces.dictionary.take(pieces.indices.take(pa.array(start[:-1]))).dictionary_encode()
        of_head = [np.frombuffer(x, "<u4") for x in self.remembered(heads.dictionary.to_pylist())]
        unclear = [x[-1:].isspace() for x in heads.dictionary.to_pylist()]
        out, at = [], 0
        for k, (head, upto, alone) in enumerate(zip(heads.indices.to_pylist(), ends, whole.tolist())):
            if alone or unclear[head] and start[k + 1] > start[k] + 1:
                out.append(self.library(texts[k].as_py()))
            else:
                out.append(np.concatenate([of_head[head], ids[at:upto]]))
            at = upto
        return out


def keys_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    kind, shift = (np.uint32, 16) if left.dtype == np.uint16 else (np.uint64, 32)
    return left.astype(kind) << kind(shift) | right.astype(kind)


def parts_of(names: np.ndarray) -> np.ndarray:
    """The two symbols of each key."""
    shift = 16 if names.dtype == np.uint32 else 32
    return np.column_stack([names >> names.dtype.type(shift), names & names.dtype.type((1 << shift) - 1)]).astype(np.int64)


def halve_runs(distinct: np.ndarray, count: np.ndarray, key: np.ndarray, at: np.ndarray, same: np.ndarray) -> None:
    """Of n equal symbols in a row only half can be paired: ``count`` set right for the pairs of equal symbols, which
    are ``same`` among the pairs ``key`` at the places ``at``."""
    at, key = at[same], key[same]
    if len(at):
        first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (key[1:] != key[:-1])))
        of = np.searchsorted(distinct, key[first])
        count[of] = 0
        np.add.at(count, of, (np.diff(np.append(first, len(at))) + 1) // 2)


def pair_counts(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of every pair of neighbours, the distinct keys and how often each occurs without overlap."""
    key = keys_of(s[:-1], s[1:])
    order = np.sort(key)
    first = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
    count = np.diff(np.append(first, len(order)))
    distinct = order[first]
    same = np.flatnonzero(s[:-1] == s[1:])
    halve_runs(distinct, count, key[same], same, np.ones(len(same), bool))
    return key, distinct, count


def occurrences(key: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``key`` of the names (ascending), and which name each is. A table of hashes tells most."""
    kind, shift = key.dtype.type, 8 * key.itemsize - 18
    mixed = lambda x: (x * kind(0x9E3779B1 if shift < 32 else 0x9E3779B97F4A7C15)) >> kind(shift)
    table = np.full(1 << 18, -1, np.int32)
    table[mixed(names)] = np.arange(len(names))
    place = table[mixed(key)]
    at = np.flatnonzero(place >= 0)
    place, own = place[at], key[at]
    wrong = np.flatnonzero(names[place] != own)  # another key of the same hash, which may be a name as well
    place[wrong] = np.minimum(np.searchsorted(names, own[wrong]), len(names) - 1)
    ok = names[place] == own
    return at[ok], place[ok]


def without_overlap(every: np.ndarray, of: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs ``of`` at the places ``every``: which pairs get ``least`` places that do not overlap, at which
    places, and the pair of each place."""
    allowed = np.ones(len(count), bool)
    while True:
        # of pairs that overlap, every other from the left
        kept = allowed[of]
        at, which = every[kept], of[kept]
        run = np.append(True, np.diff(at) > 1)
        begin = np.maximum.accumulate(np.where(run, at, -1))
        taken = (at - begin) % 2 == 0
        at, which = at[taken], which[taken]
        poor = np.flatnonzero(allowed & (np.bincount(which, minlength=len(count)) < least))
        if not len(poor):
            return allowed, at, which
        # pairs in each other's way: the rarer half gives way, for this round (all, if there are many that do not have
        # to). One pair alone is never poor
        if len(every) < 20_000 or len(poor) == allowed.sum():
            poor = poor[np.argsort(count[poor], kind="stable")][: (len(poor) + 1) // 2]
        allowed[poor] = False


def repair(s: np.ndarray, size: int, least: int = LEAST) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rounds of Re-Pair on symbols below ``size``: the symbols left, and the pairs of each round, named on from
    ``size``. No pair of what is left occurs ``least`` times."""
    rounds, places = [], None
    while len(s) > 1:
        if places is None:
            key, distinct, count = pair_counts(s)
            top = int(count.max())
            chosen = count >= max(least, top // 8)
            names, count, whole = distinct[chosen], count[chosen], top // 8 <= least
            if not len(names):
                break
            every, of = occurrences(key, names)
        else:
            # only these places can have a pair that pays: such as did before, and neighbours of new symbols
            key = keys_of(s[places], s[places + 1])
            distinct, of, count = np.unique(key, return_inverse=True, return_counts=True)
            halve_runs(distinct, count, key, places, s[places] == s[places + 1])
            chosen = count >= least
            if not chosen.any():
                break
            number, whole = np.cumsum(chosen) - 1, True
            names, count = distinct[chosen], count[chosen]
            every, of = places[chosen[of]], number[of[chosen[of]]]
        ok, at, which = without_overlap(every, of, count, least)
        name = np.where(ok, size + np.cumsum(ok) - 1, 0)
        size += int(ok.sum())
        rounds.append(parts_of(names[ok]))
        keep, changed = np.ones(len(s), bool), np.zeros(len(s), bool)
        keep[at + 1] = False
        changed[at], changed[at + 1] = True, True
        s = s.astype(np.int64 if size > 65_536 else s.dtype)
        s[at] = name[which]
        s = s[keep]
        places = None
        if whole:
            now = np.cumsum(keep) - 1
            fresh = now[at]
            places = np.zeros(len(s) + 1, bool)  # the last is for what would be before the first
            for x in (now[every[~changed[every] & ~changed[every + 1]]], fresh, fresh - 1):
                places[x] = True
            places = np.flatnonzero(places[: len(s) - 1])
    return s, rounds


def compress(documents: list[np.ndarray], least: int = LEAST) -> bytes:
    """A shard of documents."""
    ids = np.concatenate([*documents, np.zeros(0, np.uint32)]).astype(np.int64)
    seen = np.bincount(ids) > 0 if len(ids) else np.zeros(0, bool)
    alphabet, place = np.flatnonzero(seen), np.cumsum(seen) - 1
    s = place[ids].astype(np.uint16 if len(alphabet) <= 65_536 else np.int64) if len(ids) else ids
    size = len(alphabet)
    s, rules = repair(s, size, least)
    starts = np.cumsum([0, *map(len, rules)])[:-1].tolist()
    rules = np.concatenate([*rules, np.zeros((0, 2), np.int64)])
    lengths = rule_lengths(rules, starts, size)
    own = symbol_lengths(s, lengths, size)
    before = np.cumsum(own) - own
    width = 2 if size + len(rules) <= 65_536 else 4
    return b"".join(
        [
            HEAD.pack(b"RPT2", width, size, len(starts), len(rules), len(documents), len(s), len(ids)),
            np.array(starts, "<u4").tobytes(),
            alphabet.astype("<u4").tobytes(),
            rules.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            np.array([len(d) for d in documents], "<u8").tobytes(),
            before[::STEP].astype("<u8").tobytes(),
            s.astype(f"<u{width}").tobytes(),
        ]
    )


def rule_lengths(rules: np.ndarray, starts: list[int], size: int) -> np.ndarray:
    lengths = np.zeros(len(rules), np.int64)
    for a, b in zip(starts, [*starts[1:], len(rules)]):  # rules of a round are made of symbols before it
        lengths[a:b] = sum(symbol_lengths(rules[a:b, k], lengths, size) for k in (0, 1))
    return lengths


def symbol_lengths(s: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([np.ones(size, np.int64), lengths])[s]


class Shard:
    """A shard's parts, as they lie in its bytes, and what each symbol stands for."""

    def __init__(self, data: bytes):
        magic, width, size, rounds, rules, documents, symbols, self.ids = HEAD.unpack_from(data)
        if magic != b"RPT2":
            raise ValueError("not a shard of token ids")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.starts = take("<u4", rounds).astype(np.int64)
        self.alphabet = take("<u4", size)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate([np.ones(size, np.int64), take("<u4", rules).astype(np.int64)])
        self.sizes = take("<u8", documents).astype(np.int64)
        self.before = take("<u8", -(-symbols // STEP)).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)
        # what symbols stand for, end to end: a round's rules are made of symbols before it
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), "<u4")
        self.flat[:size] = self.alphabet
        for a, b in zip(self.starts, [*self.starts[1:], rules]):
            self.flat[self.first[size + a] : self.first[size + a] + self.lengths[size + a : size + b].sum()] = self.expand(self.rules[a:b].ravel())

    def expand(self, s: np.ndarray) -> np.ndarray:
        """The ids of symbols."""
        size = self.lengths[s]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.first[s] - end + size, size) + np.arange(end[-1] if len(end) else 0)]

    def read_range(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end`` (exclusive)."""
        start, end = max(0, start), min(end, self.ids)
        if start >= end:
            return np.zeros(0, "<u4")
        a = STEP * (int(np.searchsorted(self.before, start, "right")) - 1)
        b = STEP * int(np.searchsorted(self.before, end, "left"))
        skip = start - int(self.before[a // STEP])
        return self.expand(self.symbols[a:b])[skip : skip + end - start]

    def document(self, k: int) -> np.ndarray:
        start = int(self.sizes[:k].sum())
        return self.read_range(start, start + int(self.sizes[k]))

    def documents(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols), np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []


def write(docs: DataFrame, path: str | None = None, end_id: int = 2, shard: int = SHARD) -> DataFrame:
    """The shards, written to the shared folder: (part, seq, doc_ids, offset, n_ids, data), ``offset`` being
    the ids before the shard within its part. Parts are ranges of ``doc_id`` in order."""
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as file:
        text = file.read()
    shared = spark.sparkContext.broadcast(text)  # of the tokenizer's fixed size
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    # the row number lets even one id that very many rows share be dealt to several tasks
    rows = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(shared.value)
        ids, held, size, seq, offset, part = [], [], 0, 0, 0, 0

        def flush():
            nonlocal ids, held, size, seq, offset
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([offset], pa.int64()), pa.array([size], pa.int64()), pa.array([compress(held)], pa.binary()),
                ],
                names=["part", "seq", "doc_ids", "offset", "n_ids", "data"],
            )
            ids, held, size, seq, offset = [], [], 0, seq + 1, offset + size
            return out

        for batch in batches:
            for some in byte_slices(batch, most=SLICE):
                part = some.column(3)[0].as_py()
                for doc, found in zip(some.column(0).to_pylist(), enc.encode(some.column(1))):
                    ids.append(doc)
                    held.append(np.append(found, np.uint32(end_id)))
                    size += len(found) + 1
                    if size >= shard:
                        yield flush()
        if held:
            yield flush()

    out = rows.mapInArrow(tidy(run), "part int, seq int, doc_ids array<long>, offset long, n_ids long, data binary")
    return stage(out, "token_shards")


_encoders: dict[int, LibraryEncoder] = {}


def library_encoder(text: str) -> LibraryEncoder:
    key = zlib.crc32(text.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(text)
    return _encoders[key]


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, decoded from the shards."""
    return each_document(shards, "ids array<long>", lambda ids: ids.astype(np.int64))


def each_document(shards: DataFrame, column: str, f) -> DataFrame:
    """(doc_id, start, n_tokens, ``column``): ``f`` of every document's ids, as read from the shards."""
    name, kind = column.split(" ", 1)
    # a row per part, of which there are as many as shuffle partitions
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    base = base.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    rows = shards.join(F.broadcast(base), "part").select("doc_ids", (F.col("base") + F.col("offset")).cast("long").alias("first"), "data")
    to_arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column(2)[k].as_buffer())
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes + batch.column(1)[k].as_py()
                found, ids = shard.documents(), batch.column(0)[k].as_py()
                for a in range(0, len(ids), 500):
                    b = a + 500
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a:b], pa.int64()), pa.array(starts[a:b]), pa.array(shard.sizes[a:b]), pa.array([f(x) for x in found[a:b]], to_arrow)],
                        names=["doc_id", "start", "n_tokens", name],
                    )

    return rows.mapInArrow(tidy(run), f"doc_id long, start long, n_tokens long, {column}")
