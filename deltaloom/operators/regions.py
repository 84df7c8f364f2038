"""Region summaries: what a patch modifies and where.

Input: ``regions`` with ``patch_id, ordinal, off, len, kind`` (kind: write, fill, copy, xor, meta).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("write", "fill", "copy", "xor", "meta")
BUCKETS = 56


def end(off="off", length="len") -> Column:
    """Where a region ends, or null beyond 64 bits."""
    return F.try_add(F.col(off), F.col(length))


def median(values: Column) -> Column:
    """The element in the middle of the sorted values, the upper one of two."""
    return F.element_at(F.sort_array(values), (F.size(values) / 2).cast("int") + 1)


def percent(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, halves to the even digit."""
    return F.bround(part * 1000 / whole, 0) / 10


def summary(regions: DataFrame) -> DataFrame:
    """One row per patch: totals, kinds, written range, sizes (G1 to G3, G6, G12). One aggregation: sums and
    extremes are combined before the shuffle; the sizes of a patch are its own records' and stay together."""
    some = F.col("len") != 0
    return (
        regions.groupBy("patch_id")
        .agg(
            F.count(F.lit(1)).alias("n_regions"),
            F.sum("len").alias("total_modified"),
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
            F.min(F.when(some, F.col("off"))).alias("range_start"),
            F.max(F.when(some, end())).alias("range_end"),
            F.min("len").alias("min_size"),
            F.max("len").alias("max_size"),
            F.sort_array(F.collect_list("len")).alias("sizes"),
        )
        .withColumn("median_size", F.element_at("sizes", F.expr("cast(size(sizes) div 2 as int) + 1")))
        .withColumn("mean_size", F.expr("total_modified div n_regions"))
        .withColumn("uniform", F.col("min_size") == F.col("max_size"))
        .drop("sizes")
    )


def histogram(regions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Per patch and occupied column of the written range: records and bytes that start in it, and whether
    any region spans it (G4). Columns are max(1, ceil(length / buckets)) wide."""
    some = regions.filter("len <> 0").withColumn("end", end()).filter("end IS NOT NULL")
    span = some.groupBy("patch_id").agg(F.min("off").alias("lo"), F.max("end").alias("hi"))
    span = span.withColumn("width", F.expr(f"greatest(1L, (hi - lo + {buckets - 1}) div {buckets})"))
    placed = some.join(span, "patch_id").select(
        "patch_id", "width", "len", F.expr("(off - lo) div width").alias("first"), F.expr("(`end` - 1 - lo) div width").alias("last")
    )
    cells = placed.select("patch_id", "width", "len", "first", F.explode(F.sequence("first", "last")).alias("bucket"))
    starts = F.col("bucket") == F.col("first")
    return cells.groupBy("patch_id", "bucket").agg(
        F.max("width").alias("width"),
        F.count_if(starts).alias("n_records"),
        F.coalesce(F.sum(F.when(starts, F.col("len"))), F.lit(0)).alias("n_bytes"),
    )


def occupied_runs(cells: DataFrame) -> DataFrame:
    """Runs of neighbouring occupied columns of :func:`histogram`, with their share of the bytes."""
    w = Window.partitionBy("patch_id").orderBy("bucket")
    fresh = (F.col("bucket") - F.lag("bucket").over(w) > 1).cast("int")
    runs = cells.withColumn("fresh", F.coalesce(fresh, F.lit(0))).withColumn("run", F.sum("fresh").over(w))
    runs = runs.groupBy("patch_id", "run").agg(
        F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes")
    )
    whole = F.sum("n_bytes").over(Window.partitionBy("patch_id"))
    return runs.withColumn("percent", percent(F.col("n_bytes"), whole))


def tally(regions: DataFrame) -> DataFrame:
    """Totals by kind over all patches (G2, G12); kinds without a record are absent."""
    return regions.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("len").alias("n_bytes"), F.count_distinct("patch_id").alias("n_patches")
    )


def size_change(sizes: DataFrame) -> DataFrame:
    """(patch_id, source_size, target_size) with the change and its sense."""
    change = F.col("target_size") - F.col("source_size")
    sense = F.when(change > 0, "grows").when(change < 0, "shrinks").otherwise("keeps")
    return sizes.withColumn("change", change).withColumn("sense", sense)
