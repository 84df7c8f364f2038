import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deltaloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Encoder(bpe.MergeAutomaton(f.read())), Tokenizer.from_file(PATH)


def same(pair, text):
    enc, lib = pair
    ids = lib.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == ids, text
    assert enc.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_random_texts_against_the_library(pair):
    rnd = random.Random(1)
    for alphabet in ("aaaabbbccdde eethions .,\n\t  é語👍ß", "ab", "0123456789 -=", "the anion of re "):
        for _ in range(800):
            same(pair, "".join(rnd.choices(alphabet, k=rnd.randint(0, 70))))


def test_odd_texts(pair):
    for t in (
        "", " ", "\n", "a  b", "x \n y ", "aaaaaaaaaaaa" * 9, " " * 99, "=" * 200, "it's we'll I'VE can't", "<|endoftext|> a<|endoftext|><|endoftext|>\n",
        " 　\x85 x\x1c\x1d y", "word" * 30_000,
    ):
        same(pair, t)


def test_documents_against_the_library(pair, sf, spark):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        same(pair, r.text)


def test_every_character_is_split_as_the_library_does(pair):
    enc, lib = pair
    for start in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(start, start + 64) if not 0xD800 <= c <= 0xDFFF)
        if text:
            assert enc.split(text) == [text[s:e] for _, (s, e) in lib.pre_tokenizer.pre_tokenize_str(text)]


def test_merges_of_a_small_vocabulary_against_repeated_merging():
    """The automaton against the definition: merge the leftmost pair of the least rank, again and again."""
    import json

    rnd = random.Random(3)
    for trial in range(60):
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 9:
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in tokens and len(u + v) <= 8:
                merges.append([u, v])
                tokens.append(u + v)
        auto = bpe.MergeAutomaton(json.dumps({"model": {"vocab": {t: k for k, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []}))
        for _ in range(150):
            word = "".join(rnd.choices("abc", k=rnd.randint(1, 12)))
            parts = list(word)
            for u, v in merges:
                i = 0
                while i + 1 < len(parts):
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert [tokens[i] for i in auto.word(word.encode())] == parts, (merges, word)


def test_query_and_tables(spark, sf, pair):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = pair[1].encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "x y", 1), (4, "x y", 1), (4, "x y", 1)]
    encoded = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids long"))
    assert [(r.doc_id, len(r.ids)) for r in encoded.collect()] == [(1, 0), (2, 0), (None, 2), (4, 2), (4, 2)]
    assert [r.text for r in bpe.decode(encoded).collect()] == ["", "", "x y", "x y", "x y"]
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
