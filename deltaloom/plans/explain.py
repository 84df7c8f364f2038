"""Whole questions over a catalogue of patches, put together of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checksums
from ..operators import apply, create, regions, verify
from ..sources import containers


def explain(patches: DataFrame) -> DataFrame:
    """What each patch of (patch_id, content) modifies and where (I2). Payloads are pruned before the shuffle."""
    return regions.summary(containers.regions(containers.records(patches)))


def measured(images: DataFrame, side: str) -> DataFrame:
    """(patch_id, side, kind, actual) of (patch_id, bytes): digests and size, in the JVM."""
    size, crc, md5, sha1 = checksums.digests(F.col("bytes"))
    wide = images.select("patch_id", size.cast("string").alias("size"), crc, md5, sha1)
    return wide.unpivot("patch_id", ["size", "crc32", "md5", "sha1"], "kind", "actual").withColumn("side", F.lit(side)).select("patch_id", "side", "kind", "actual")


def verified(patches: DataFrame, sources: DataFrame) -> DataFrame:
    """Verdicts of the source-side checks of (patch_id, content) against (patch_id, bytes)."""
    checks = containers.checks(patches).filter("side = 'source'")
    return verify.verdicts(patches, verify.weigh(checks, measured(sources, "source")))


def converted(patches: DataFrame, sources: DataFrame, fmt: str) -> DataFrame:
    """Patches of (patch_id, content) made anew in another format, by applying and creating (K2): (id, format,
    patch, error)."""
    heads = containers.headers(patches).select("patch_id", "format")
    rows = patches.join(heads, "patch_id").join(sources, "patch_id")
    done = apply.apply_patches(rows.select(F.col("patch_id").alias("id"), "format", F.col("content").alias("patch"), F.col("bytes").alias("image")))
    pairs = done.filter("output IS NOT NULL").join(sources.withColumnRenamed("patch_id", "id"), "id")
    return create.create_patches(pairs.select("id", F.col("bytes").alias("source"), F.col("output").alias("target")), fmt)
