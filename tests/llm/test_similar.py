import random

import corpus_pipeline
import numpy as np
import pytest
from deltaloom.llm import similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def brute(texts):
    """The least place of each text's class."""
    each, label = [*map(shingles, texts)], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(each[i] & each[j])
            if 5 * common >= 4 * (len(each[i]) + len(each[j]) - common):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def planted():
    """Pairs of similarity 0.70 to 0.96, and a group of 90 copies of one text with one line common to all."""
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    line, out = words(12), []
    for k in range(120):
        text = words(rnd.randrange(60, 400)) + line
        other = list(text)
        gap = rnd.uniform(0.02, 0.18) * len(text)
        for i in rnd.sample(range(len(text)), max(1, round(gap / 5))):
            other[i] = f"x{k}"
        out += [text, other]
    base = words(200)
    for k in range(90):
        text = list(base)
        for i in rnd.sample(range(200), rnd.randrange(1, 7)):
            text[i] = f"y{k}"
        out.append(text)
    rnd.shuffle(out)
    return [" ".join(t) for t in out]


def linked_by(label):
    """The pairs of places that a labelling holds together."""
    return {(i, j) for j in range(len(label)) for i in range(j) if label[i] == label[j]}


@pytest.mark.parametrize("how", [{}, {"few": 4, "tile": 24, "part": 8}])
def test_links_against_brute_force(spark, how):
    texts = planted()
    want = linked_by(brute(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r.component_id for r in similar.near_duplicates(docs, **how).collect()}
    got = linked_by([found[i] for i in range(len(texts))])
    assert not got - want  # nothing that is less alike
    assert len(got & want) >= 0.98 * len(want)
    assert all(found[i] <= i for i in found)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.86 alone, of short and of long texts."""
    rnd = random.Random(4)
    texts = []
    for k in range(500):
        n = rnd.choice([30, 60, 200])
        text = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        texts += [text, text[: round(n * rnd.uniform(0.81, 0.86))]]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    alike = []
    for i in range(0, len(texts), 2):
        a, b = shingles(texts[i]), shingles(texts[i + 1])
        if 5 * len(a & b) >= 4 * len(a | b):
            alike.append(i)
        else:
            assert found[i + 1] == i + 1
    assert len(alike) > 250
    assert sum(found[i + 1] == i for i in alike) >= 0.95 * len(alike)


def test_stage_keeps_one_of_each_class(spark, sf):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    got = sorted(r.doc_id for r in corpus_pipeline.dissimilar(spark, docs, sf).collect())
    assert got == sorted(set(found.values()))


def test_lower_bound_and_plans():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 2**63, (500, similar.WORDS), np.uint64) for _ in range(2))
    d = similar.counts(x) ^ similar.counts(y)
    low, high = d & similar.EVEN, d >> np.uint64(1) & similar.EVEN
    manhattan = (np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)).sum(1)
    assert (manhattan <= np.bitwise_count(x ^ y).sum(1)).all()
    sizes = [similar.plan(n) for n in (0, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and all(g * 0.733**s > 5 for s, g in sizes)


def test_grouping_finds_all_candidates_of_a_cell():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, similar.WORDS), np.uint64)
    prints = base[rng.integers(0, 40, 900)] ^ (np.uint64(1) << rng.integers(0, 64, (900, similar.WORDS)).astype(np.uint64))
    keys, sizes = np.sort(rng.integers(0, 2, 900)), np.full(900, 50)
    a, b, _, large = similar.grouped(keys, prints, sizes, 800, few=1000)
    assert (large < 0).all()
    i, j = np.triu_indices(900, 1)
    ok = (keys[i] == keys[j]) & similar.candidates(prints[i], prints[j], sizes[i], sizes[j], 800)
    want = set(zip(i[ok].tolist(), j[ok].tolist()))
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want


def test_edges(spark):
    rows = [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (3, "A B\tc d\ne f g h"), (9, None), (8, ""), (7, " \n "), (4, "one two"), (None, "stands alone")]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    kept = similar.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "stands alone"), (3, rows[2][1]), (4, "one two"), (7, " \n ")]
    assert similar.deduplicate(docs.limit(0)).count() == 0
