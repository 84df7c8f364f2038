"""Reading tables and writing intermediate ones to the folder that all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset (tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/deltaloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage, so a lost executor costs a re-read and not a re-computation, and pins
    whatever would differ between two evaluations (row ids, sampled rows).
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")  # what was shuffled for this table is not needed beyond it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes what :func:`stage` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/deltaloom/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def least_hashed(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About the ``rows`` rows whose hashes of the columns are the least, a few more on average and all of a
    small table: what a bounded sample is then ordered and cut from, without a top list from every task."""
    n = df.count()
    if n <= 8 * rows:
        return df
    return df.filter(F.xxhash64(*columns) < F.lit(int(2**64 * 4 * rows / n) - 2**63))


def byte_slices(batch: pa.RecordBatch, text: str | int = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose texts hold about ``most`` bytes (a longer text is a piece of its own), so that what is
    made of a piece is bounded by bytes and not by rows."""
    held = batch.column(text)
    if isinstance(held, pa.StructArray):
        held = held.field("text")
    if not batch.num_rows:
        return
    # a row counts for a few bytes even if it has no text
    total = np.cumsum(pc.fill_null(pc.binary_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(total):
        end = int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right"))
        end = max(end, start + 1)
        yield batch.slice(start, end - start)
        start = end


#: Rows that make a key hot, and hot keys at most.
HOT, HOT_KEYS = 256, 1000


def hot_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` (one row a key). Rows of hot keys stay where they are: the side's rows of keys
    that more than 256 rows and more than a thousandth of all have, of which there are a thousand at most, are
    broadcast. Only the other keys are shuffled. Both tables should be staged: they are read twice."""
    counts = rows.groupBy(key).count()
    least = max(HOT, rows.count() // HOT_KEYS)
    hot = stage(counts.filter(F.col("count") > least).select(F.col(key).alias("hot_key")), "hot_keys")
    if hot.isEmpty():
        return rows.join(side, key, how)
    is_hot = lambda df: df[key] == hot["hot_key"]
    cold = rows.join(F.broadcast(hot), is_hot(rows), "left_anti").join(side, key, how)
    few = side.join(F.broadcast(hot), is_hot(side), "left_semi")
    warm = rows.join(F.broadcast(hot), is_hot(rows), "left_semi").join(F.broadcast(few), key, how)
    return cold.unionByName(warm)


#: Buckets that a table of ids is told by.
ID_BUCKETS = 1 << 20


def split_by(docs: DataFrame, key, special: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose ``key`` (a column of them) certainly is not in ``special`` (a table of one column of
    keys), and all others, which have to be joined. Only hashes of the keys are broadcast, a million at most, so
    the texts of the first rows are not moved. Keys and hashes are of any type; null is a key."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    held = stage(special.select(bucket(F.col(special.columns[0])).alias("id_bucket")).distinct(), "id_buckets")
    marked = docs.withColumn("own_bucket", bucket(key))
    same = F.col("own_bucket") == F.col("id_bucket")
    few = F.broadcast(held)
    return tuple(marked.join(few, same, how).drop("own_bucket") for how in ("left_anti", "left_semi"))


def release() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def release_driver() -> None:
    """Gives the driver's free memory back. Proxies of plans that only cycles hold go first, as the JVM keeps what they
    stand for until then."""
    gc.collect()
    release()


def tidy(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, after which a worker that waits for its next task does not hold what it needed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
