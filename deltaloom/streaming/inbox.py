"""Patches that arrive in a folder: parsed as they come, by Structured Streaming. An addition of this engine.

Parsing keeps no state, so a stream needs no watermark; each micro-batch is the same plan as a batch of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """(patch_id, path, content): new files, with a number made of their path."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("patch_id"), "path", "content")


def headers(spark: SparkSession, path: str, **how) -> DataFrame:
    """The header, or the error, of every patch that arrives."""
    return containers.headers(arriving(spark, path, **how))


def catalogue(spark: SparkSession, path: str, out: str, checkpoint: str, **how):
    """Writes headers and records of what has arrived as tables under ``out``, each file once; returns the
    finished query."""

    def write(batch: DataFrame, number: int) -> None:
        patches = batch.persist()
        containers.headers(patches).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/headers/batch={number}")
        containers.records(patches).write.mode("overwrite").parquet(f"{out}/records/batch={number}")
        patches.unpersist()

    stream = arriving(spark, path, **how).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
