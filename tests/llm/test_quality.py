import random

from pyspark.sql import functions as F

from deltaloom.llm import quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string"
LABELS = "doc_id long, quality int, toxic int"


def made(n, seed=1):
    """Good texts, shouted and marked-up junk, and texts with one bad word."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeioulnrst", k=rnd.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for d in range(n):
        ws = rnd.choices(words, k=rnd.randint(10, 200))
        kind = rnd.choice(["good", "good", "good", "junk", "bad"])
        if kind == "bad":
            ws.insert(rnd.randrange(len(ws)), rnd.choice(["vile", "nasty", "awful"]))
        text = " ".join(w.upper() + "!!" for w in ws) if kind == "junk" else " ".join(ws) + "."
        docs.append((d, text, rnd.choice(["en", "de"]), f"src{rnd.randrange(5)}", len(text), 0.0, "x"))
        labels.append((d, int(kind != "junk"), int(kind == "bad")))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made(3000)
    rows = spark.createDataFrame(docs, DOCS)
    scored = quality.classify(rows, spark.createDataFrame(labels[:2000], LABELS))
    truth = {d: q == 1 and t == 0 for d, q, t in labels}
    out = [(r.doc.doc_id, r.keep) for r in scored.collect()]
    held = [(truth[d], k) for d, k in out if d >= 2000]
    assert len(out) == 3000
    assert sum(k for t, k in held if t) / sum(t for t, _ in held) > 0.97
    assert sum(not k for t, k in held if not t) / sum(not t for t, _ in held) > 0.97


def test_views_exchange_labels(spark):
    docs, labels = made(1500, 2)
    rows = spark.createDataFrame(docs, DOCS)
    model = quality.learn(rows, spark.createDataFrame(labels[:1000], LABELS), quality.Sizes(rounds=2))
    assert model.accuracy["kept_good"] > 0.95 and model.accuracy["rejected_bad"] > 0.9
    p = quality.score(rows, model).select("doc.doc_id", "p_text", "p_page").collect()
    junk = [r for r, (_, q, t) in zip(sorted(p), labels) if q == 0]
    assert sum(r.p_page < 0.5 for r in junk) / len(junk) > 0.95  # the page view knows junk by itself


def test_query_covers_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op2_quality"](spark, sf)
    assert got.columns == ["doc_id", "p_text", "p_page", "score", "keep"]
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and got.count() == docs.count()


def test_edges(spark):
    docs, labels = made(400, 3)
    odd = [(9001, None, None, None, None, None, None), (9002, "", "en", "s", 0, None, None), (None, "some text", None, None, None, None, None), (9003, "vile " * 60_000, "en", "s", 1, None, None)]
    rows = spark.createDataFrame(docs + odd + odd[1:2], DOCS)
    more = labels + [(0, 0, 0), (5, None, 1), (None, 1, 0), (8, 1, None)]
    got = quality.classify(rows, spark.createDataFrame(more, LABELS))
    assert got.count() == len(docs) + 5 and got.filter("keep IS NULL OR score IS NULL").count() == 0
    assert got.select("doc.*").columns == rows.columns
    assert not got.filter("doc.doc_id = 9003").first().keep
    assert quality.classify(rows.filter(F.lit(False)), spark.createDataFrame(labels, LABELS)).count() == 0
    nothing = quality.classify(rows, spark.createDataFrame([], LABELS))
    assert nothing.filter("keep").count() == len(docs) + 5 and nothing.filter("score IS NOT NULL").count() == 0


def test_pseudo_labels_are_counted_over_all_documents(spark):
    """The counts that are summed up in Spark, against a plain loop over the documents."""
    docs, labels = made(900, 5)
    rows = spark.createDataFrame(docs, DOCS).repartition(7)
    sizes = quality.Sizes(rounds=0, confident=0.8)
    model = quality.learn(rows, spark.createDataFrame(labels[:600], LABELS), sizes)
    words, n_words, page, n_page = quality.pseudo_counts(rows, model.views, sizes)
    scored = {r.doc.doc_id: r for r in quality.score(rows, model).collect()}
    want, n = {}, [0, 0]
    for d, text, *_ in docs:
        p = scored[d].p_page
        for k, sure in ((0, p >= 0.8), (1, p <= 1 - 0.8)):
            if sure:
                n[k] += 1
                for h in quality.word_ids(text):
                    want.setdefault(h, [0, 0])[k] += 1
    assert n_words.tolist() == n and min(n) > 0
    assert {int(h): words[h].tolist() for h in words.any(1).nonzero()[0]} == want
    sure = [r.p_text >= 0.8 for r in scored.values()], [r.p_text <= 1 - 0.8 for r in scored.values()]
    assert n_page.tolist() == [sum(x) for x in sure]
    assert page.sum() == sum(n_page) * (len(model.views.edges) + 2)


def test_ties_and_repeated_rows(spark):
    docs, labels = made(500, 6)
    rows = spark.createDataFrame(docs + docs[:40] + docs[:40], DOCS)
    got = quality.classify(rows, spark.createDataFrame(labels, LABELS)).collect()
    seen = {}
    for r in got:
        seen.setdefault(r.doc.doc_id, set()).add((r.score, r.keep))
    assert len(got) == 580 and all(len(x) == 1 for x in seen.values())


def test_memory_is_given_back_once_the_sample_is_dropped(monkeypatch):
    calls = []
    for name in ("learn", "release_driver", "score"):
        monkeypatch.setattr(quality, name, lambda *_, name=name: calls.append(name))
    quality.classify(None, None)
    assert calls == ["learn", "release_driver", "score"]
