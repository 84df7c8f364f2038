import hashlib
import random
import re

from pyspark.sql import functions as F

from deltaloom.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, n_chars long, items string, spans long"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    ws, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        size = min(window, len(iw))
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for i in range(len(ws) - size + 1 if iw else 0):
            if tuple(ws[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add("" if name is None else str(name))
    return len(ws), sorted(hit), sorted(found)


def flat(spans):
    return [i for s, e in spans for i in range(s, e)]


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in queries.QUERIES["op8_decontaminate"](spark, sf).collect():
        n, hit, found = brute(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_random_words_against_brute_force():
    rnd = random.Random(2)
    for trial in range(120):
        make = lambda n: " ".join(rnd.choices("abc", k=n))
        items = [(k, make(rnd.randint(0, 9))) for k in range(rnd.randint(0, 6))]
        window = rnd.randint(1, 6)
        auto = decontaminate.SuffixAutomaton([(str(k), t) for k, t in items], window)
        for _ in range(15):
            text = make(rnd.randint(0, 40)) + rnd.choice(["", " x ", " d"]) + make(rnd.randint(0, 9))
            spans, owners = auto.match(decontaminate.words(text))
            _, hit, found = brute(text, items, window)
            assert flat(spans) == hit and sorted(auto.names[k] for k in owners) == found


def test_blocks_of_items_give_the_same(spark):
    rnd = random.Random(6)
    make = lambda n: " ".join(rnd.choices("abcdefg", k=n))
    items = [(k, make(rnd.randint(1, 30))) for k in range(30)]
    docs = [(k, make(80), 1, "x", 2) for k in range(20)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    one, many = (decontaminate.find(d, b, 4, n).orderBy("doc.doc_id").collect() for n in (10_000, 20))
    assert [(flat(r.spans), r.items) for r in one] == [(flat(r.spans), r.items) for r in many]
    assert [(flat(r.spans), r.items) for r in one] == [brute(t, items, 4)[1:] for _, t, *_ in docs]


def test_spans_are_removed_and_clean_documents_left_alone(spark):
    item = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda"
    rows = [
        (1, "Before it. " + " filler" * 20 + " ALPHA beta gamma delta epsilon zeta eta theta iota, kappa lambda; after é it." + " more" * 20, 5, "x", 2),
        (2, "a clean text, alpha beta gamma delta", 9, "x", 2),
        (3, item, 7, "x", 2),
        (4, None, None, None, None),
        (None, "", 0, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    items = spark.createDataFrame([(1, item), (1, item), (None, None), (2, " ")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(got) == {1, 2, 4, None}
    assert "ALPHA" not in got[1].text and "kappa" not in got[1].text and "after é it." in got[1].text
    assert got[1].n_chars == len(got[1].text) and got[2] == (2, rows[1][1], 9, "x", 2)
    assert decontaminate.decontaminate(docs, items).columns == docs.columns


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, "", 1)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.spans, r.items) for r in decontaminate.find(docs, items).collect()] == [(2, [], [])]
    assert decontaminate.find(docs.filter(F.lit(False)), items).count() == 0


def test_very_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(12))
    text = "x " * 60_000 + item + " y" * 60_000
    found = decontaminate.find(spark.createDataFrame([(1, text, 1, "", 1)], DOCS), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (found.n_words, [list(s) for s in found.spans], found["items"]) == (120_012, [[60_000, 60_012]], ["7"])
