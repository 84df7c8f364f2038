"""Checks and classes of single records (F2 to F17) and their roll-ups.

Records have ``patch_id, ordinal, off, len``; sizes come as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fits_within(off: Column, length: Column, size: Column) -> Column:
    """The record lies inside ``size`` bytes, without overflow (F2)."""
    return (off >= 0) & (length >= 0) & (off <= size) & (length <= size - off)


def placement(off: Column, length: Column, size: Column) -> Column:
    """fits, partly (a prefix fits) or past."""
    return F.when(length <= size - off, "fits").when(off < size, "partly").otherwise("past")


def clip(records: DataFrame, size: str) -> DataFrame:
    """Each record's place against ``size`` and the bytes of it that fit."""
    off, length, limit = F.col("off"), F.col("len"), F.col(size)
    return records.withColumn("place", placement(off, length, limit)).withColumn(
        "kept", F.greatest(F.lit(0).cast("long"), F.least(length, limit - off))
    )


def clip_summary(clipped: DataFrame) -> DataFrame:
    """Per patch: how many records are cut or dropped, the first of them, and how far the last overshoots
    (G9, G10)."""
    out = F.col("place") != "fits"
    return clipped.groupBy("patch_id").agg(
        F.count_if(F.col("place") == "partly").alias("n_partly"),
        F.count_if(F.col("place") == "past").alias("n_past"),
        F.min(F.when(out, F.col("ordinal"))).alias("first_ordinal"),
        F.sum(F.col("len") - F.col("kept")).alias("lost_bytes"),
    )


def output_size(records: DataFrame, source_size: str) -> DataFrame:
    """Per patch the larger of the source's size and the last end of a record that has bytes."""
    last = F.max(F.when(F.col("len") > 0, F.try_add("off", "len")))
    return records.groupBy("patch_id").agg(F.max(source_size).alias("source_size"), last.alias("record_end")).select(
        "patch_id", "source_size", F.greatest("source_size", F.coalesce("record_end", F.lit(0))).alias("output_size")
    )


def truncation(declared: Column, natural: Column) -> Column:
    """What a truncation marker does to an output of ``natural`` size."""
    return F.when(declared.isNull(), "absent").when(declared < natural, "honored").when(declared == natural, "no-op").otherwise("ignored")


def copy_class(output: Column, source: Column, length: Column) -> Column:
    """How a copy from earlier output overlaps itself: disjoint, a one-byte run, or a longer period."""
    distance = output - source
    return F.when(distance >= length, "disjoint").when(distance == 1, "run").otherwise("overlap")


def wire_offset(off: Column, largest: Column) -> Column:
    """Whether a format can write the offset (F8)."""
    return F.when(off < 0, "negative").when(off > largest, "too large").otherwise("ok")


def size_gate(fmt: Column, source: Column, target: Column) -> Column:
    """Whether a direct format can carry a change of size."""
    return (
        F.when(target == source, True)
        .when(fmt.isin("PPF1", "PPF3"), False)
        .when(fmt == "APS-N64", True)
        .when(fmt == "IPS", F.when(target > source, target <= 0xFFFFFF + 0xFFFF).otherwise(target <= 0xFFFFFF))
        .otherwise(target > source)
    )


def copier_headed(size: Column) -> Column:
    """The size of an image with a 512-byte copier header."""
    return size.bitwiseAND(0xFFF) == 0x200


def refusals(records: DataFrame, ceiling: str) -> DataFrame:
    """The first record of a patch that no image can hold, and why."""
    why = (
        F.when(F.col("off") < 0, "negative offset")
        .when(F.col("len") < 0, "negative length")
        .when(F.try_add("off", "len").isNull() | (F.col("off") + F.col("len") > F.col(ceiling)), "past the ceiling")
    )
    bad = records.withColumn("why", why).filter("why IS NOT NULL")
    return bad.groupBy("patch_id").agg(F.min(F.struct("ordinal", "why")).alias("f"), F.count(F.lit(1)).alias("n_bad")).select(
        "patch_id", F.col("f.ordinal").alias("first_ordinal"), F.col("f.why").alias("why"), "n_bad"
    )


def split(records: DataFrame, cap: int) -> DataFrame:
    """Records cut into pieces of at most ``cap`` bytes (F14); an empty record gives none."""
    at = F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(cap).cast("long"))
    pieces = records.filter("len > 0").withColumn("skip", F.explode(at))
    return pieces.select(
        "patch_id", "ordinal", (F.col("off") + F.col("skip")).alias("off"), F.least(F.lit(cap).cast("long"), F.col("len") - F.col("skip")).alias("len")
    )


def runs_of_one_byte(payload: Column) -> Column:
    """Whether a payload is better written as a run: four bytes or more, all equal (F16)."""
    text = F.hex(payload)
    return (F.octet_length(payload) >= 4) & (text == F.repeat(F.substring(text, 1, 2), F.octet_length(payload)))


def phases(records: DataFrame, source_size: str) -> DataFrame:
    """Records cut at the source's end into replaced and appended pieces."""
    edge = F.greatest(F.lit(0).cast("long"), F.least(F.col("len"), F.col(source_size) - F.col("off")))
    both = records.withColumn("edge", edge)
    old = both.filter("edge > 0").select("patch_id", "ordinal", F.lit("replace").alias("phase"), "off", F.col("edge").alias("len"))
    new = both.filter("edge < len").select(
        "patch_id", "ordinal", F.lit("append").alias("phase"), (F.col("off") + F.col("edge")).alias("off"), (F.col("len") - F.col("edge")).alias("len")
    )
    return old.unionByName(new)


def source_part(records: DataFrame, size: str) -> DataFrame:
    """How much of a copied block the source has, and how many zero bytes stand in for the rest."""
    have = F.greatest(F.lit(0).cast("long"), F.least(F.col("len"), F.col(size) - F.col("off")))
    where = F.when(have == F.col("len"), "inside").when(have > 0, "straddles").otherwise("past")
    return records.withColumn("from_source", have).withColumn("zeros", F.col("len") - have).withColumn("where", where)


def overlaps(records: DataFrame) -> DataFrame:
    """Pairs of overlapping records per patch (J5, W8), by a sweep over starts and ends instead of a join of
    records with records: n log n, whatever the overlap. Empty records overlap nothing; at one position ends
    come before starts."""
    some = records.filter("len > 0").withColumn("end", F.try_add("off", "len")).filter("end IS NOT NULL")
    events = some.select(
        "patch_id", F.explode(F.array(F.struct(F.col("off").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e")
    ).select("patch_id", "e.at", "e.step")
    w = Window.partitionBy("patch_id").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, -1)
    opened = events.withColumn("open", F.coalesce(F.sum("step").over(w), F.lit(0)))
    return opened.groupBy("patch_id").agg(F.sum(F.when(F.col("step") == 1, F.col("open")).otherwise(0)).alias("n_pairs"), F.max("open").alias("deepest"))


def unsorted(records: DataFrame) -> DataFrame:
    """The first record that starts before the one written before it."""
    w = Window.partitionBy("patch_id").orderBy("ordinal")
    return records.withColumn("before", F.lag("off").over(w)).filter("before > off").groupBy("patch_id").agg(
        F.min("ordinal").alias("first_ordinal"), F.count(F.lit(1)).alias("n_unsorted")
    )


def gaps(records: DataFrame, size: str) -> DataFrame:
    """What lies between the records up to the image's end, as copies from the source (W12, C4). Records are
    sorted and disjoint."""
    w = Window.partitionBy("patch_id").orderBy("off", "ordinal")
    before = F.coalesce(F.lag(F.col("off") + F.col("len")).over(w), F.lit(0))
    inner = records.withColumn("start", before).filter("off > start").select("patch_id", "start", F.col("off").alias("end"))
    tail = records.groupBy("patch_id").agg(F.max(F.col("off") + F.col("len")).alias("start"), F.max(size).alias("end")).filter("end > start")
    return inner.unionByName(tail)
