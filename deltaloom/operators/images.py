"""Byte images: whole, in pairs, and cut into chunks that Spark can deal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

CHUNK = 1 << 20


def documents(docs: DataFrame) -> DataFrame:
    """(image_id, bytes) of documents; a null text is an empty image."""
    return docs.select(F.col("doc_id").alias("image_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))


def neighbours(images: DataFrame) -> DataFrame:
    """(pair_id, source, target): each image and the one before it by id. Ranks are prefix sums over range
    partitions and the pairing is a join by rank, so no task orders all images."""
    ids = images.select("image_id").repartitionByRange("image_id").sortWithinPartitions("image_id")
    ids = staged(ids.select("image_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ids")
    # one row per range partition: as many as the setting says, whatever the number of images
    sizes = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    ranked = ids.join(F.broadcast(base), "part").select("image_id", (F.col("at") + F.col("shift")).alias("rank"))
    later = ranked.select(F.col("image_id").alias("pair_id"), (F.col("rank") - 1).alias("rank"))
    pairs = ranked.join(later, "rank").drop("rank")
    one = images.select("image_id", F.col("bytes").alias("source"))
    two = images.select(F.col("image_id").alias("pair_id"), F.col("bytes").alias("target"))
    return pairs.join(one, "image_id").join(two, "pair_id").select("pair_id", "source", "target")
