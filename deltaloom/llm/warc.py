"""WARC archives and their Merkle fixity audit, in DataFrame functions.

An archive is a stream of WARC records, ordered by page id and digest, in which every record has a byte
offset. Its Merkle tree has the records' SHA-256 as leaves. A node of the first level covers the records
that start in a range of ``RANGE`` bytes, a node above it ``FANOUT`` ranges, up to one root. The hash of a
node is that of its children's numbers and hashes in order, so that a record lost, added or damaged changes
its own branch and no other. Two replicas are compared by their roots; below nodes that differ, and only
there, the children are compared, down to the records.

Offsets are prefix sums in two steps (within range partitions, and over their totals), and only keys,
lengths and digests are shuffled for them. No group is larger than a range holds records.

Defined results: null url and html count as empty, a null page id is written as nothing and comes first.
Rows that are repeated whole are one record, with their number in ``copies``. Pages that share an id but
differ are records of their own, ordered by digest. Empty tables make an empty archive, and empty archives
are equal. Other columns are ignored; pages are read whole, and twice, so they should be a table that gives
the same rows each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import stage

RANGE = 1 << 16
FANOUT = 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A response record, in bytes."""
    body = F.encode(html, "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        page_id,
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, offset, length, copies, sha256, record), written to the shared folder."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # made twice, for the keys and for the archive: writing them in between would hold every byte once more
    rows = pages.select("page_id", record(text("page_id"), text("url"), text("html")).alias("record"))
    rows = rows.withColumn("sha256", F.sha2("record", 256))
    # one row per distinct record, without its bytes
    keys = rows.groupBy("page_id", "sha256").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("record")).cast("long").alias("length"))
    keys = stage(keys.repartitionByRange("page_id", "sha256").withColumn("part", F.spark_partition_id()), "keys")
    before = Window.partitionBy("part").orderBy("page_id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range partition: their number is a setting and does not grow with the rows
    totals = keys.groupBy("part").agg(F.sum("length").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = keys.withColumn("within", F.coalesce(F.sum("length").over(before), F.lit(0)))
    placed = placed.join(F.broadcast(base), "part")
    placed = placed.select(
        F.col("page_id").alias("id"), F.col("sha256").alias("digest"), (F.col("base") + F.col("within")).cast("long").alias("offset"), "length", "copies"
    )
    one = rows.join(placed, rows["page_id"].eqNullSafe(placed["id"]) & (rows["sha256"] == placed["digest"]))
    first = one.filter("copies = 1").select("page_id", "offset", "length", "copies", "sha256", "record")
    again = one.filter("copies > 1").groupBy("page_id", "offset", "length", "copies", "sha256").agg(F.first("record").alias("record"))
    return stage(first.unionByName(again), "archive")


def leaves(replica: DataFrame) -> DataFrame:
    """(node, hash): a record by its offset. Several records at one offset, as a damaged replica may have
    them, are hashed together."""
    each = replica.select(F.col("offset").alias("node"), F.sha2("record", 256).alias("hash"))
    return each.groupBy("node").agg(F.sort_array(F.collect_list("hash")).alias("all")).select(
        "node", F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.sha2(F.concat_ws("", "all"), 256)).alias("hash")
    )


def above(nodes: DataFrame, width: int) -> DataFrame:
    """The level over ``nodes``: ranges of ``width`` of them."""
    children = F.sort_array(F.collect_list(F.struct("node", "hash")))
    said = F.concat_ws("", F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["hash"], F.lit(";"))))
    return nodes.groupBy(F.expr(f"node div {width}").alias("up")).agg(F.sha2(said, 256).alias("hash")).toDF("node", "hash")


def tree(replica: DataFrame, last: int) -> list[DataFrame]:
    """The levels, records first, for offsets up to ``last``: the uppermost is one root (or none)."""
    levels, width = [stage(leaves(replica), "leaves")], RANGE
    while True:
        levels.append(stage(above(levels[-1], width), "nodes"))
        last //= width
        if not last:
            return levels
        width = FANOUT


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, expected, found): nodes that differ or that one side lacks."""
    both = a.withColumnRenamed("hash", "expected").join(b.withColumnRenamed("hash", "found"), "node", "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("found")))


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """(offset, kind, expected, found): records in which replica ``b`` differs from ``a``, as ``corrupt``,
    ``missing`` or ``extra``. Replicas have ``offset`` and ``record``."""
    last = a.select("offset").union(b.select("offset")).agg(F.max("offset")).first()[0] or 0
    one, two = tree(a, last), tree(b, last)
    wrong = stage(differing(one[-1], two[-1]), "differing")
    for k in range(len(one) - 2, -1, -1):
        if wrong.isEmpty():
            break  # whatever is below is equal as well
        width = RANGE if k == 0 else FANOUT
        parents = wrong.select(F.col("node").alias("parent"))
        below = [x.join(parents, F.expr(f"node div {width}") == F.col("parent"), "left_semi") for x in (one[k], two[k])]
        wrong = stage(differing(*below), "differing")
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return wrong.select(F.col("node").alias("offset"), kind.alias("kind"), "expected", "found")
