"""Conversion as set algebra between what a patch has and what a target takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dims import OUTPUT_FIELDS


def test(patches: DataFrame, contracts: DataFrame) -> DataFrame:
    """Every patch (``patch_id, have``) against every target. A dropped field that affects the output refuses
    first, then a required field that is missing; the rest of what is dropped is noted (X1, X4). The contracts
    are a fixed handful of rows."""
    both = patches.crossJoin(F.broadcast(contracts))
    both = both.withColumn("takes", F.array_union("required", "accepted"))
    both = both.withColumn("dropped", F.array_sort(F.array_except("have", "takes"))).withColumn(
        "missing", F.array_sort(F.array_except("required", "have"))
    )
    fatal = F.array_intersect("dropped", F.array(*map(F.lit, OUTPUT_FIELDS)))
    verdict = (
        F.when(F.col("target") == "PPF4", "refuse: never from records")
        .when(F.size(fatal) > 0, F.concat(F.lit("refuse: drops "), F.array_join(fatal, ",")))
        .when(F.size("missing") > 0, F.concat(F.lit("refuse: lacks "), F.array_join("missing", ",")))
        .otherwise("accept")
    )
    return both.select("patch_id", "target", verdict.alias("verdict"), F.array_join("dropped", ",").alias("dropped"))


def keepers(field_targets: DataFrame, fields: DataFrame) -> DataFrame:
    """The targets that preserve each field."""
    return fields.join(field_targets, "field", "left_semi")


def metadata(requests: DataFrame, accepted: DataFrame) -> DataFrame:
    """Requested metadata that the format does not take refuses."""
    both = requests.join(F.broadcast(accepted), "format", "left")
    extra = F.array_sort(F.array_except("asked", F.coalesce("accepts", F.array().cast("array<string>"))))
    return both.select("patch_id", "format", F.array_join(extra, ",").alias("refused"), (F.size(extra) == 0).alias("ok"))


def merged(carried: DataFrame, given: DataFrame, fields: list[str]) -> DataFrame:
    """Metadata field by field, what is given over what is carried."""
    g = given.select("patch_id", *[F.col(f).alias(f"given_{f}") for f in fields])
    return carried.join(g, "patch_id", "left").select("patch_id", *[F.coalesce(f"given_{f}", f).alias(f) for f in fields])
