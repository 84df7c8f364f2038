import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deltaloom.llm import queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, data string, part long"


def brute(docs):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) in order, by the library alone."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sf):
    got = [tuple(r) for r in queries.QUERIES["op7_token_files"](spark, sf).orderBy("doc_id").collect()]
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert got == brute(docs)


def test_edges_and_many_shards(spark):
    long = "word and another word " * 9_000
    docs = [
        (None, "no number"), (1, None), (2, ""), (3, "a  b \n c\n d <|endoftext|> e"), (4, long), (5, " lead"), (5, "trail "),
        (7, "՘Ᲊ 　x é語👍 it's we'LL"), (8, "x"),
    ]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).coalesce(1)
    shards = token_files.write(rows, shard=50)
    got = token_files.each_document(shards, "crc long", lambda ids: zlib.crc32(ids.tobytes())).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute(docs)
    ids = {r.start: r.ids for r in token_files.read(shards).collect()}
    assert [len(ids[r.start]) for r in got] == [r.n_tokens for r in got]
    assert shards.count() >= 2
    assert token_files.read(token_files.write(spark.createDataFrame([], DOCS))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5) | st.integers(0, 70_000), max_size=300), max_size=8), st.booleans())
def test_round_trip_and_random_access(docs, narrow):
    top = 50_000 if narrow else 70_001
    docs = [np.array([x % top for x in d], np.uint32) for d in docs]
    data = token_files.compress(docs, least=2)
    shard = token_files.Shard(data)
    assert [d.tolist() for d in shard.documents()] == [d.tolist() for d in docs]
    flat = [x for d in docs for x in d.tolist()]
    rnd = random.Random(len(flat))
    for _ in range(10):
        a, b = sorted((rnd.randint(0, len(flat)), rnd.randint(0, len(flat))))
        assert shard.read_range(a, b).tolist() == flat[a:b]
    assert [shard.document(k).tolist() for k in range(len(docs))] == [d.tolist() for d in docs]


def test_repetitive_ids_get_small():
    ids = np.tile(np.arange(100, dtype=np.uint32), 3000)
    data = token_files.compress([ids])
    assert len(data) < 2 * len(ids) / 10
    shard = token_files.Shard(data)
    assert (shard.read_range(123_456, 123_999) == ids[123_456:123_999]).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 30), max_size=600), st.integers(2, 7), st.sampled_from([np.uint16, np.int64]))
def test_no_pair_that_pays_is_left(ids, least, kind):
    s, rounds = token_files.repair(np.array(ids, kind), 31, least)
    rules = [tuple(p) for r in rounds for p in r.tolist()]
    assert len(set(rules)) == len(rules)
    back = lambda x: [x] if x < 31 else back(rules[x - 31][0]) + back(rules[x - 31][1])
    assert [y for x in s.tolist() for y in back(x)] == ids
    counts, left = {}, s.tolist()
    for pair in set(zip(left, left[1:])):
        n = k = 0
        while k < len(left) - 1:
            hit = (left[k], left[k + 1]) == pair
            n, k = n + hit, k + 1 + hit
        counts[pair] = n
    assert max(counts.values(), default=0) < least
    whole = [y for x in s.tolist() for y in back(x)]
    for k, pair in enumerate(rules):  # a rule is used often enough to pay
        assert sum(r.count(31 + k) for r in rules) + left.count(31 + k) >= 1 and whole == ids


def test_pieces_and_words(spark):
    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        enc = token_files.LibraryEncoder(file.read())
    pieces = ["plain", "Été,", "été!", "x.\nThe", "it's", "'s", "a'LL", "a1b", "12,", "ƀ", "日本語,", "日本", "한국어.", "é́", "a\tb", "$5", "-", "a.\nb", "a\n\nb", "\nb", "a\n", "é\nÉ\n's", "x\n-y\n12", "x\r\ny", "a\n՘", ",", ";;", "ﬁ", "ª", "²", "՘", "Ა"]
    texts = ["go " + p for p in pieces] + ["go " + " ".join(pieces)] * 2
    for text, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_a_piece_is_looked_up_once_for_many_texts():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        enc = token_files.LibraryEncoder(file.read())
    enc.known = Counted()
    texts = ["first " + "one two Three. " * 500 + "end", None, "", " ", "a  b", "a\n b", "two <|endoftext|> one", "one\n", "\n two"] * 20
    for some in (texts, pa.array(texts), pa.array(texts).slice(3, 50)):
        want = some if isinstance(some, list) else some.to_pylist()
        for text, ids in zip(want, enc.encode(some), strict=True):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
    assert enc.known.asked < 100 and enc.encode([]) == []
    assert enc.held < 2000 * len(enc.known)


def test_a_new_word_costs_no_entry_and_few_calls():
    with open(PATH, encoding="utf-8") as file:
        enc = token_files.LibraryEncoder(file.read())
    calls, model, rnd = [], enc.model, random.Random(3)
    enc.model = lambda x: calls.append(x) or model(x)
    word = lambda: "".join(rnd.choices("abcdéeiostu", k=rnd.randint(4, 9)))
    texts = [" ".join([f"{word()}{rnd.choice(['', ',', '.', chr(10) + word()])}" for _ in range(400)]) for _ in range(20)]
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    # the first words of the texts alone are remembered, and the model gets 16 distinct words a call
    distinct = {w for t in texts for w in t.replace("\n", " ").replace(",", "").replace(".", "").split()}
    assert len(enc.known) <= len(texts) and len(calls) <= 2 * len(distinct) / 16 + 2


PARTS = ["a", "Z", "é", "'", "'s", "'ll", "'re", "'d", "'x", "1", "½", "-", ".", "!!", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "日", "한", "\u0301", "՘", "👍", "the", "\0", "<|", "<|endoftext|>", "x" * 70, " ", " ", " ", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=6))
def test_any_mix_of_characters(texts):
    enc = encoder()
    for text, ids in zip(texts, enc.encode(texts), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text


def encoder():
    with open(PATH, encoding="utf-8") as file:
        return token_files.library_encoder(file.read())
