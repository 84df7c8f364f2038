import random

import pytest
import xxhash

from deltaloom.llm import components, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fp(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows, distance=4):
    """rows: (doc_id, fp)"""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(rows))]


def test_query_against_brute_force(spark, sf):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op3_simhash"](spark, sf).collect()}
    docs = [(r.doc_id, brute_fp(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {d: (f"{fp:016x}", c) for (d, fp), c in zip(docs, brute_components(docs))}
    assert got == want


@pytest.mark.parametrize("blocks, tile", [(6, 7), (7, 10_000), (8, 5)])
def test_links_lose_no_connection(spark, blocks, tile):
    rnd = random.Random(blocks)
    fps = set()
    for _ in range(30):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(40):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 6)))
            fps.add(x)
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    df = spark.createDataFrame([(d, simhash.signed(fp)) for d, fp in rows], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(df, blocks=blocks, tile=tile).collect()}
    assert [got[simhash.signed(fp)] for _, fp in rows] == brute_components(rows)


def test_large_cells_are_searched_whole(spark):
    # 600 fingerprints that agree in their first 40 bits lie in one cell of a grid
    rnd = random.Random(5)
    rows = [(i, rnd.getrandbits(24) | 3 << 60) for i in range(600)]
    df = spark.createDataFrame([(d, simhash.signed(fp)) for d, fp in rows], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(df).collect()}
    assert [got[simhash.signed(fp)] for _, fp in rows] == brute_components(rows)


def test_edges(spark):
    long = "word " * 50_000 + "end"
    rows = [
        (5, "a b c d e f g h", "en", "s", 1),
        (5, "a b c d e f g h", "en", "s", 1),
        (3, "A B\tc d\ne f g h", "en", "s", 1),
        (9, None, None, None, None),
        (8, "", "en", "s", 0),
        (7, " \n ", "en", "s", 3),
        (6, long, "en", "s", len(long)),
        (4, "one two", "en", "s", 7),
        (None, "quite another text that stands alone here", None, None, None),
        (None, "and one more text of which nobody knows the number", None, None, None),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", fp long")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.component_id is None, r.component_id or 0) for r in got) == sorted(
        [(False, 3)] * 3 + [(False, 7)] * 3 + [(False, 6), (False, 4), (True, 0), (True, 0)]
    )
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted(
        [(3, rows[2][1]), (7, " \n "), (6, long), (4, "one two"), (0, rows[8][1]), (0, rows[9][1])]
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    rows = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, **{200 + i: 100 for i in range(50)}}
