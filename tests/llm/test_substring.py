import hashlib
import random

import numpy as np

from deltaloom.llm import queries, substring

DOCS = "doc_id long, text string, names long, copy string"


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, size=50):
    """docs: (doc_id, text); what is kept of each"""
    least = {}
    for d, t in docs:
        ws = split(t or "")
        for i in range(len(ws) - size + 1 if d is not None else 0):
            w = " ".join(ws[i : i + size])
            least[w] = min(d, least.get(w, d))
    out = []
    for d, t in docs:
        ws = split(t or "")
        gone = set()
        for i in range(len(ws) - size + 1 if d is not None else 0):
            if least[" ".join(ws[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


def made(seed, n, vocabulary, size):
    """Documents put together of shared passages, own words and long runs."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(size // 2, 3 * size))] for _ in range(6)]
    docs = []
    for d in range(n):
        ws = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.randrange(4)
            if kind == 0:
                ws += [rnd.choice(words) for _ in range(rnd.randint(0, 2 * size))]
            elif kind == 1:
                ws += [rnd.choice(words)] * rnd.randint(1, 3 * size)
            elif kind == 2:
                ws += rnd.choices(words, k=2) * rnd.randint(1, size)
            else:
                p = rnd.choice(passages)
                a = rnd.randint(0, len(p) // 3)
                ws += p[a : len(p) - rnd.randint(0, len(p) // 3)]
        docs.append((d * 7 % n, rnd.choice([" ", "\n"]).join(ws)))
    return docs


def test_query_against_brute_force(spark, sf):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op5_substring_dedup"](spark, sf).collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(docs)]
    assert ordered(got) == ordered(want)


def test_made_documents_against_brute_force(spark):
    for seed, vocabulary, size in ((1, 5, 12), (2, 400, 50), (3, 2, 20)):
        docs = made(seed, 60, vocabulary, size)
        rows = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS)
        got = [(r.doc.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(rows, size).collect()]
        assert ordered(got) == ordered(brute(docs, size))


def test_equal_windows_have_equal_symbols():
    rnd = np.random.default_rng(4)
    shared = rnd.integers(0, 40, 90).astype(np.uint64)
    for _ in range(30):
        a, b = (rnd.integers(0, 40, rnd.integers(0, 60)).astype(np.uint64) for _ in range(2))
        one = substring.Parsed([np.concatenate([a, shared, b])], 50)
        two = substring.Parsed([shared], 50)
        names = [set(p.names.tolist()) | set(p.bare_names.tolist()) for p in (one, two)]
        assert names[1] <= names[0]


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = " ".join(str(i % 977) for i in range(30_000))
    docs = [(1, passage), (1, passage), (2, passage), (2, "other " + passage), (3, None), (4, ""), (None, passage), (5, long), (6, "x " + long), (7, "short")]
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS)
    got = [(r.doc.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.deduplicate(rows).collect()]
    assert ordered(got) == ordered(brute(docs))
    assert substring.deduplicate(spark.createDataFrame([], DOCS)).count() == 0
