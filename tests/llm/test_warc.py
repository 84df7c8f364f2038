import hashlib

from pyspark.sql import functions as F

from deltaloom.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, offset long")


ROWS = [
    (3, "http://a", "<p>a</p>", 0),
    (1, None, "long " * 40_000, 0),
    (2, "http://é", "", 0),
    (2, "http://b", None, 0),
    (4, "http://b", "x", 0),
    (4, "http://b", "x", 0),
    (None, "http://n", "é", 0),
    *[(10 + i, "u", "y" * (i * 997 % 5000), 0) for i in range(120)],
]


def brute_record(page_id, url, html):
    body = (html or "").encode()
    name = "" if page_id is None else page_id
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{name}>\r\nWARC-Target-URI: {url or ''}\r\n"
    return f"{head}Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def brute_archive(rows):
    distinct = {(p, brute_record(p, u, h)) for p, u, h, _ in rows}
    out, at = [], 0
    for p, r in sorted(distinct, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1]).hexdigest())):
        out.append((p, at, len(r), r))
        at += len(r)
    return out


def test_archive_against_brute_force(spark):
    got = warc.archive(pages(spark, ROWS)).orderBy("offset").collect()
    assert [(r.page_id, r.offset, r.length, bytes(r.record)) for r in got] == brute_archive(ROWS)
    assert {r.page_id: r.copies for r in got}[4] == 2


def test_audit_finds_what_differs(spark):
    a = warc.archive(pages(spark, ROWS)).select("offset", "record")
    offsets = [r.offset for r in a.orderBy("offset").collect()]
    bad, lost = offsets[7], offsets[-3]
    extra = spark.createDataFrame([(offsets[5] + 1, bytearray(b"new"))], "offset long, record binary")
    b = a.filter(F.col("offset") != lost).withColumn("record", F.when(F.col("offset") == bad, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("record")))
    found = {r.offset: (r.kind, r.expected is None, r.found is None) for r in warc.audit(a, b.union(extra)).collect()}
    assert found == {bad: ("corrupt", False, False), lost: ("missing", False, True), offsets[5] + 1: ("extra", True, False)}


def test_equal_and_empty_replicas(spark):
    a = warc.archive(pages(spark, ROWS)).select("offset", "record")
    assert warc.audit(a, a).count() == 0
    none = warc.archive(pages(spark, [])).select("offset", "record")
    assert none.count() == 0 and warc.audit(none, none).count() == 0
    assert {r.kind for r in warc.audit(none, a.limit(3)).collect()} == {"extra"}


def test_only_branches_that_differ_change(spark):
    a = warc.archive(pages(spark, ROWS)).select("offset", "record")
    last = a.agg(F.max("offset")).first()[0]
    hurt = a.withColumn("record", F.when(F.col("offset") == last, F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("record")))
    one, two = warc.tree(a, last), warc.tree(hurt, last)
    assert len(one) == len(two) >= 3 and one[-1].count() == 1
    assert [warc.differing(x, y).count() for x, y in zip(one, two)] == [1] * len(one)


def test_records_are_written_once(spark, monkeypatch):
    """What an archive writes: keys without bytes, and the records as they stay."""
    wide, stage = [], warc.stage
    monkeypatch.setattr(warc, "stage", lambda df, label: wide.append(label) or stage(df, label) if "record" in df.columns else stage(df, label))
    assert warc.archive(pages(spark, ROWS)).count() == len(brute_archive(ROWS))
    assert wide == ["archive"]
