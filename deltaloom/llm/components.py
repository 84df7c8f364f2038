"""Connected components of a link table, by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is two aggregations
and joins by node; it is written to the shared folder, so that neither plan nor recovery grows with the
rounds. Aggregations combine before the shuffle, and the links of hot nodes are joined where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import drop_staged, hot_join, release_driver, stage


def _least(pairs: DataFrame) -> DataFrame:
    return stage(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two columns of longs); the component is the
    least node. Links of a node to itself, repeated links and null ends count for nothing. Rounds go on until
    nothing changes; their number grows with the logarithm of the links' number."""
    a, b = (F.col(f"`{c}`") for c in links.columns)
    now = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    while True:
        both = now.union(now.select("v", "u"))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = hot_join(both, least, "u").filter("v > u and v > m")
        large = stage(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_stars")
        small = hot_join(large, _least(large), "u")
        small = small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").filter("u > v").distinct()
        new = stage(small, "links")
        same = _digest(new) == _digest(now)
        drop_staged(now)
        now = new
        release_driver()
        if same:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(pairs: DataFrame):
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
