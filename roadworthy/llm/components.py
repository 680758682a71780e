"""Connected components of a graph given by its links.

Alternating large-star and small-star steps: every step is a group-by-minimum
and a join on the node, so no node's neighbours are ever gathered in one
place, and the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadworthy.llm.common import written
from roadworthy.session import remove_path, shared_dir


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the component's least node."""
    spark = links.sparkSession
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    path = shared_dir(spark, "links")
    current = written(ordered.distinct(), "links", path)
    state = None
    while True:
        done, path = path, shared_dir(spark, "links")
        current = written(_small_star(_large_star(current).distinct()).distinct(), "links", path)
        remove_path(spark, done)  # nothing reads the round before
        seen = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        state = seen
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
