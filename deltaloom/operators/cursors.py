"""Cursors: positions that a decoder would keep, as running sums over records in wire order.

All are windows by patch, ordered by ordinal, so one sort serves every cursor of a format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before(value: Column, *keys: str) -> Column:
    """The sum of ``value`` over the earlier records of the patch."""
    w = Window.partitionBy("patch_id", *keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")


def output(records: DataFrame, skip: str | None = None, terminator: int = 0) -> DataFrame:
    """Where each record writes: the sum of the lengths before it (W1). Block formats skip bytes first and
    step over a terminator."""
    if skip is None:
        return records.withColumn("out", before(F.col("len")))
    step = F.col(skip) + F.col("len") + terminator
    return records.withColumn("out", before(step) + F.col(skip))


def copies(records: DataFrame) -> DataFrame:
    """Output position, and for copies the position that they read (W3, W4): each kind of copy moves a cursor
    of its own by ``delta``, and then by what it copied. ``op``: source_copy, target_copy or other."""

    def cursor(kind: str) -> Column:
        mine = F.col("op") == kind
        return F.when(mine, before(F.when(mine, F.col("delta") + F.col("len")).otherwise(0)) + F.col("delta"))

    reads = F.coalesce(cursor("source_copy"), cursor("target_copy"))
    out = before(F.col("len"))
    return records.withColumn("out", out).withColumn("reads", reads).withColumn(
        "fault",
        F.when(F.col("reads") < 0, "underflow").when((F.col("op") == "target_copy") & (F.col("reads") >= F.col("out")), "ahead of output"),
    )


def triples(records: DataFrame) -> DataFrame:
    """The four cursors of (add, copy, seek) triples: difference block, extra block, source, output."""
    return (
        records.withColumn("diff_at", before(F.col("add")))
        .withColumn("extra_at", before(F.col("copy")))
        .withColumn("source_at", before(F.col("add") + F.col("seek")))
        .withColumn("out", before(F.col("add") + F.col("copy")))
    )


def sequential(records: DataFrame) -> DataFrame:
    """Offsets of instructions whose source counts on (``sequential``), by source."""
    return records.withColumn("at", F.when(F.col("sequential"), before(F.col("len"), "source")).otherwise(F.col("off")))


def windows(records: DataFrame) -> DataFrame:
    """Where each file window starts: the sizes of the windows before it."""
    w = Window.partitionBy("patch_id").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("base", F.coalesce(F.sum("target_size").over(w), F.lit(0)).cast("long"))


def appended(records: DataFrame, source_size: str) -> DataFrame:
    """Appends follow the source's end, one after another (W11); replaces are where they say."""
    mine = F.col("phase") == "append"
    at = F.col(source_size) + before(F.when(mine, F.col("len")).otherwise(0))
    return records.withColumn("at", F.when(mine, at).otherwise(F.col("off")))


def even(windows_: DataFrame) -> DataFrame:
    """Per patch: windows, checksummed ones, those with a source, and whether all but the last are of one size
    (G13, G18)."""
    last = F.max("window_no").over(Window.partitionBy("patch_id"))
    rows = windows_.withColumn("inner", F.col("window_no") < last)
    return rows.groupBy("patch_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("origin") == "source").alias("n_from_source"),
        F.count_if(F.col("origin") == "target").alias("n_from_target"),
        F.sum("target_size").alias("target_size"),
        (F.count_distinct(F.when(F.col("inner"), F.col("target_size"))) <= 1).alias("even"),
    )


def opcode_pairs(records: DataFrame) -> DataFrame:
    """How often one operation follows another."""
    w = Window.partitionBy("patch_id").orderBy("ordinal")
    pairs = records.withColumn("then", F.lead("op").over(w)).filter("then IS NOT NULL")
    return pairs.groupBy("op", "then").agg(F.count(F.lit(1)).alias("n"))
