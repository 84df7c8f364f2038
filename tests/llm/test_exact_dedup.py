from deltaloom.llm import exact_dedup

DOCS = "doc_id long, text string, digest string, row long, kept boolean"
ROWS = [
    (1, "a", "x", 1, None), (5, "a", "y", 2, None), (3, "a", "z", 3, None), (2, "b", None, None, None), (2, "b", None, None, None), (2, "B", "q", 1, True),
    (7, None, None, None, None), (8, "", None, None, None), (None, "a", None, None, None), (None, "only", None, None, None), (9, "long " * 50_000, None, 1, None),
]


def index(spark, tmp_path, name):
    return exact_dedup.DigestIndex(spark, f"digests_{name}", f"file://{tmp_path}/{name}", 4)


def test_one_of_each_text_stays(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = exact_dedup.deduplicate(docs, index(spark, tmp_path, "one"), "first")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted([(5, "a"), (2, "b"), (2, "B"), (8, ""), (0, "only"), (9, ROWS[-1][1])])


def test_later_batches_are_held_against_the_index(spark, tmp_path):
    idx = index(spark, tmp_path, "two")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "b"), (4, "c"), (5, "c")], "doc_id long, text string")
    assert {r.doc_id for r in exact_dedup.deduplicate(first, idx, "1").collect()} == {1, 2}
    assert {r.doc_id for r in exact_dedup.deduplicate(second, idx, "2").collect()} == {5}
    assert {r.doc_id for r in exact_dedup.deduplicate(second, idx, "3").collect()} == set()
    assert idx.known().count() == idx.known().distinct().count() == 3
    assert {(r.keep_id, r.group_size) for r in idx.current().collect()} == {(1, 1), (5, 4), (3, 3)}
    plan = idx.unseen(exact_dedup.representatives(exact_dedup.digests(second)))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_assignment(spark, tmp_path):
    got = exact_dedup.groups(spark.createDataFrame(ROWS, DOCS), index(spark, tmp_path, "three")).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.keep_id, r.group_size) for r in got if r.doc_id == 1) == [(5, 4)]
    assert sum(r.kept for r in got) == 6 and sum(r.kept for r in got if r.doc_id == 2) == 2


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.deduplicate(docs, index(spark, tmp_path, "four"), "x").count() == 0
    assert exact_dedup.groups(docs, index(spark, tmp_path, "five")).count() == 0


def test_two_batches_go_through_the_anti_join(spark, tmp_path):
    """Texts that both halves of the ids hold, and one that a third of all rows share."""
    rows = [(i, f"t{i % 40}" if i % 3 else "hot") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    idx = index(spark, tmp_path, "six")
    got = exact_dedup.groups(docs, idx).collect()
    last, size = {}, {}
    for i, t in rows:
        last[t], size[t] = i, size.get(t, 0) + 1
    text = dict(rows)
    assert len(got) == 1200
    for r in got:
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size, r.kept) == (last[t], size[t], r.doc_id == last[t])
    assert idx.read().filter("batch = 'newer' AND NOT fresh").count() == 41  # all texts had come before
    kept = exact_dedup.distinct(docs, index(spark, tmp_path, "seven"))
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(i, t) for t, i in last.items()}
