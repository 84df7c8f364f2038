"""Exact dedup on a persistent digest index.

The index is a table bucketed and sorted by a text's SHA-256. Data comes in batches. A batch is reduced to one row per
digest (partial aggregation, so a text that is a third of the batch costs one row per task), that is anti-joined with
the index by sort-merge, and what is new is appended. For digests that the index holds already, a *sighting* is
appended to the same table: which row of the batch ranks first and how many there are. So the row that stays and the
size of its group are known over all batches, and nothing in the index is ever rewritten. Texts are equal when they
are identical; a null text counts as empty.

Defined results: an empty table gives empty results. Rows that share text and ``doc_id`` are told
apart by a row number that is fixed when the digests are written, and one of them stays. A null
``doc_id`` ranks below every other. Extra columns are carried by :func:`deduplicate`, whatever
their names are. Texts of any length are hashed whole. Adding a batch again is no new data, but counts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import drop_staged, hot_join, split_by, stage


def digest(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest): 32 bytes of digest stand for a text from here on."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.unhex(digest()).alias("digest")
    )


def representatives(rows: DataFrame) -> DataFrame:
    """One row per digest: the copy with the largest ``doc_id``, and how many there are."""
    best = F.max(F.struct("doc_id", "row"))
    return (
        rows.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    )


class DigestIndex:
    """The persistent index: ``digest, keep_id, keep_row, group_size, fresh, batch``. A digest has one fresh entry, of the
    batch that brought it, and a sighting for each later batch that holds it."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        """``path``: where the table lies, in the warehouse if not given. ``buckets``: fixed when the table is made; by default the number of shuffle partitions,
        so that a batch is dealt just as the index is stored."""
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, reps: DataFrame) -> None:
        """The empty table, if there is none."""
        if not self.exists():
            self._write(reps.filter(F.lit(False)).withColumns({"fresh": F.lit(True), "batch": F.lit("")}))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def known(self) -> DataFrame:
        """Every digest once."""
        return self.read().filter("fresh").select("digest")

    def entries(self, batch: str) -> DataFrame:
        """A batch's new entries."""
        return self.read().filter((F.col("batch") == batch) & F.col("fresh"))

    def current(self) -> DataFrame:
        """(digest, keep_id, keep_row, group_size) over all batches; the buckets need no shuffle for it."""
        best = F.max(F.struct("keep_id", "keep_row"))
        each = self.read().groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        return each.select("digest", F.col("best.keep_id").alias("keep_id"), F.col("best.keep_row").alias("keep_row"), "group_size")

    def unseen(self, reps: DataFrame) -> DataFrame:
        """Representatives whose digest the index lacks: a sort-merge anti-join, and the index
        side, being bucketed and sorted by digest, is not shuffled."""
        return reps.join(self.known().hint("merge"), "digest", "left_anti")

    def seen(self, reps: DataFrame) -> DataFrame:
        return reps.join(self.known().hint("merge"), "digest", "left_semi")

    def _write(self, rows: DataFrame) -> None:
        # dealt by digest into as many partitions as buckets, so that each task writes one file
        out = rows.repartition(self.buckets, "digest").write.format("parquet")
        if self.path:
            out = out.option("path", self.path)
        out.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Deduplicates a batch of :func:`digests` within itself and against the index, appends
        what is new and what was sighted again, and returns the batch's new entries."""
        reps = stage(representatives(rows), "representatives")
        self.create(reps)
        new, again = self.unseen(reps), self.seen(reps)
        flagged = [df.withColumns({"fresh": F.lit(fresh), "batch": F.lit(batch)}) for df, fresh in ((new, True), (again, False))]
        self._write(flagged[0].unionByName(flagged[1]))
        drop_staged(reps)
        return self.entries(batch)


def assign(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Each row with the row that stays for its digest. Rows of a digest that very many share are not moved."""
    joined = hot_join(rows, entries.select("digest", "keep_id", "keep_row", "group_size"), "digest", "left")
    return joined.withColumn("kept", F.coalesce((F.col("row") == F.col("keep_row")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)))


def in_batches(docs: DataFrame, index: DigestIndex) -> tuple[DataFrame, DataFrame]:
    """The digests of all of ``docs`` and what stays for each, added to the index as two batches: the older half of the
    ids and null first, and then, as new data would come, the newer half."""
    rows = stage(digests(docs), "digests")
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    newer = F.coalesce(F.col("doc_id") > F.lit(((low or 0) + (high or 0)) // 2), F.lit(False))
    index.add(rows.filter(~newer), "older")
    index.add(rows.filter(newer), "newer")
    return rows, stage(index.current(), "current")


def groups(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """(row, doc_id, digest, keep_id, keep_row, group_size, kept) of every row, over the whole of ``docs``."""
    return assign(*in_batches(docs, index))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that stay as new data: one for each text that is new to the index. Of repeated rows
    (same text, same ``doc_id``) the one that is greatest by all its columns stays."""
    rows = stage(digests(docs), "digests")
    return _rows_of(docs, rows, stage(index.add(rows, batch), "entries"))


def distinct(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, all batches together: of each text the one with the largest ``doc_id``."""
    return _rows_of(docs, *in_batches(docs, index))


def _rows_of(docs: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``entries`` keep. Only rows that have the kept id are joined and moved."""
    each = stage(assign(rows, entries), "assigned")
    repeated = each.filter("NOT kept").select("digest").distinct()
    kept = each.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("keep_row").isNotNull())
    kept = kept.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = stage(kept.select(F.col("digest").alias("kept_digest"), F.col("doc_id").alias("kept_id"), "n"), "kept")
    drop_staged(rows)
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.unhex(digest()).alias("digest"))
    # texts that occur once, and are new, are not moved, but for a few
    sure, rest = split_by(doc, F.col("digest"), repeated)
    mine = rest.join(kept, (rest["digest"] == kept["kept_digest"]) & F.col("doc.doc_id").eqNullSafe(F.col("kept_id")))
    once = mine.filter("n = 1").select("doc")
    again = mine.filter("n > 1").groupBy("kept_digest", "kept_id").agg(F.max("doc").alias("doc")).select("doc")
    return sure.select("doc").unionByName(once).unionByName(again).select("doc.*")
