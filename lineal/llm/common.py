"""Shared helpers: connected groups, running sums."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.storage import fresh_path, materialize, unused

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "components", "delete", "fresh_path", "materialize", "offsets", "tidy", "unused"]

#: A word: a maximal run of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected groups of an undirected edge list of longs: (node, component), component the smallest
    node reachable. Nodes without edges don't appear. Alternates large-star and small-star steps until the edge list stays
    the same; self-edges and repeats are harmless; an empty list gives an empty result.

    Each step's minima are combined map-side and written to the shared folder, so that the join with them is one of two plain
    shuffles, which AQE can split where a node has most of the edges.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edge-minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), "edges")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "edge-minima")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def delete(table: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    sc = table.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more, which it does when the driver's memory is collected; a driver
    with little to do is seldom collected by itself. For steps that each leave large shuffles."""
    gc.collect()
    spark._jvm.System.gc()


def offsets(counts: DataFrame, keys: list[str], part: str, value: str, per: int = 1_000) -> DataFrame:
    """(keys, part, off): for each key, the sum of `value` over the parts, whole numbers, before each. In two levels, blocks of
    `per` parts and parts within a block, so that a key with most of the parts is spread over tasks."""
    cut = counts.withColumn("_block", F.floor(F.col(part) / per))
    sums = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_s"))
    high = sums.select(*keys, "_block", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_s")).alias("_high"))
    low = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(part)) - F.col(value)
    return cut.withColumn("_low", low).join(high, [*keys, "_block"]).select(*keys, part, (F.col("_high") + F.col("_low")).alias("off"))
