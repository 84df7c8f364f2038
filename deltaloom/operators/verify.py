"""Verification: declared checks against measured values, verdicts, header rescue.

``checks``: patch_id, side, kind, expected, severity, position (their declared order).
``measured``: patch_id, side, kind, actual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["patch_id", "side", "kind"]


def weigh(checks: DataFrame, measured: DataFrame) -> DataFrame:
    """Each check with what was measured, as held, mismatched or unmeasured (V1)."""
    both = checks.join(measured, KEY, "left")
    state = F.when(F.col("actual").isNull(), "unmeasured").when(F.col("actual") == F.col("expected"), "held").otherwise("mismatched")
    return both.withColumn("state", state)


def verdicts(patches: DataFrame, weighed: DataFrame) -> DataFrame:
    """Per patch and side: differs, matches or uncheckable (V3), and under the enforcing policy the first fatal
    mismatch in declared order, which refuses (V4). Patches without a check are kept."""
    wrong = F.col("state") == "mismatched"
    fatal = wrong & (F.col("severity") == "fatal")
    counts = weighed.groupBy("patch_id").agg(
        F.count_if(F.col("state") != "unmeasured").alias("n_checks"),
        F.count_if(wrong).alias("n_wrong"),
        F.min_by(F.when(fatal, F.col("kind")), F.when(fatal, F.col("position"))).alias("refused_by"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return patches.select("patch_id").join(counts, "patch_id", "left").select(
        "patch_id",
        n("n_checks"),
        n("n_wrong"),
        F.when(F.col("n_wrong") > 0, "differs").when(F.col("n_checks") > 0, "matches").otherwise("uncheckable").alias("verdict"),
        "refused_by",
    )


def flip(checks: DataFrame) -> DataFrame:
    """The checks of an undo: the sides change places (V7)."""
    return checks.withColumn("side", F.when(F.col("side") == "source", "target").otherwise("source"))


def rescue(images: DataFrame, widths: DataFrame) -> DataFrame:
    """Which header to add or drop so that an image has the declared size (J8, V6): ``image_id, size, wanted``
    against the few widths, both ways. ``reframe`` if exactly one arrangement fits."""
    ways = F.broadcast(widths).select("width", F.explode(F.array(F.lit(-1), F.lit(1))).alias("sense"))
    fitting = images.filter("size <> wanted").join(ways, F.col("size") + F.col("sense") * F.col("width") == F.col("wanted"))
    return fitting.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_ways"),
        F.min("width").alias("width"),
        F.when(F.count(F.lit(1)) == 1, F.when(F.min("sense") > 0, "add").otherwise("drop")).alias("reframe"),
    )
