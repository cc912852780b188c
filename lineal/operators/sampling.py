"""Weighted draws without normalising, recoalescence times, importance weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 25


def log_sum_exp(df: DataFrame, group: list[str], potential: str) -> DataFrame:
    """(group, lse): log of the sum of exponentials, steady for large potentials; one shuffle."""
    top = df.groupBy(*group).agg(F.max(potential).alias("_m"))
    return df.join(top, group).groupBy(*group).agg((F.max("_m") + F.ln(F.sum(F.exp(F.col(potential) - F.col("_m"))))).alias("lse"))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) fixed by keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53)


def gumbel_max(df: DataFrame, group: list[str], item: str, potential: str, seed: int = 0, u: Column | None = None, threshold: float = 1.0) -> DataFrame:
    """(group, item, log_p): one item of each group with chance proportional to exp(potential), by the highest
    potential plus Gumbel noise; a map-side combined maximum. Null and infinite potentials can't be drawn, unless a group
    has no other: then its items are alike. u: uniform numbers in (0, 1), else hashes of the seed, group and item.

    threshold: the share of a group's items, in their order, that is looked at; the first item that can be drawn is in any case. log_p is the
    drawn potential less that of all items looked at.
    """
    ok = F.col(potential).isNotNull() & ~F.isnan(potential) & (F.abs(potential) < float("inf"))
    u = uniform(F.lit(seed), *(F.col(g) for g in group), F.col(item)) if u is None else u
    x = df.withColumns({"_x": F.when(ok, F.col(potential)), "_g": -F.ln(-F.ln(u))})
    if threshold < 1:
        own = Window.partitionBy(*group)
        at = F.row_number().over(own.orderBy(item))
        x = x.withColumns({"_at": at, "_n": F.count(F.lit(1)).over(own)})
        first = F.min(F.when(F.col("_x").isNotNull(), F.col("_at"))).over(own)
        x = x.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("_at") == F.col("_first")) | (F.col("_at") <= F.floor(F.col("_n") * threshold)))
    some = x.groupBy(*group).agg(F.max_by(F.struct(item, "_x"), F.struct(F.col("_x").isNotNull(), F.coalesce("_x", F.lit(0.0)) + F.col("_g"))).alias("b"), F.count(F.lit(1)).alias("n"))
    lse = log_sum_exp(x.where("_x is not null"), group, "_x")
    return some.join(lse, group, "left").select(*group, F.col(f"b.{item}").alias(item), F.coalesce(F.col("b._x") - F.col("lse"), -F.ln("n")).alias("log_p"))


def density(parts: DataFrame, group: list[str], log_p: str, logscale: bool = False) -> DataFrame:
    """(group, density): of each genealogy, from the log chances of the steps that made it; further steps are further rows."""
    total = F.sum(log_p)
    return parts.groupBy(*group).agg((total if logscale else F.exp(total)).alias("density"))


def log_grid(low: float, high: float, n: int = GRID) -> list[float]:
    """n + 1 latitudes from low to high, evenly spread in logarithm."""
    import math

    a, b = math.log(low), math.log(high)
    return [low, *(math.exp(a + (b - a) * i / n) for i in range(1, n)), high]


def recoalescence(draws: DataFrame, counts: DataFrame, grid: list[float]) -> DataFrame:
    """draws (.., hazard) with clat: the latitude at which the cumulative number of lineages, summed by left ends over
    the grid, reaches the drawn hazard; beyond the last, one lineage. counts: (latitude, n) at the grid's left ends."""
    spark = draws.sparkSession
    cells = spark.createDataFrame(list(zip(range(len(grid) - 1), grid[:-1], grid[1:])), "cell int, latitude double, top double")
    run = F.sum(F.col("n") * (F.col("top") - F.col("latitude"))).over(Window.orderBy("cell"))
    steps = cells.join(counts, "latitude").withColumn("run", run).select("top", "n", "run", F.coalesce(F.lag("run").over(Window.orderBy("run")), F.lit(-1.0)).alias("before"))
    last = steps.agg(F.max("run").alias("all"), F.max("top").alias("end"))
    met = draws.join(F.broadcast(steps), (F.col("hazard") <= F.col("run")) & (F.col("hazard") > F.col("before")), "left").crossJoin(F.broadcast(last))
    clat = F.when(F.col("run").isNotNull(), F.col("top") + (F.col("hazard") - F.col("run")) / F.col("n")).otherwise(F.col("end") + F.col("hazard") - F.col("all"))
    return met.withColumn("clat", clat).drop("top", "n", "run", "before", "all", "end")


def edge_weights(edges: DataFrame, low: float) -> DataFrame:
    """(src, dst, w, log_p): candidates to recoalesce on, by their length above latitude low. edges have src_lat, dst_lat."""
    w = edges.where(F.col("src_lat") > low).select("src", "dst", (F.col("src_lat") - F.greatest("dst_lat", F.lit(low))).alias("w"))
    total = w.agg(F.sum("w").alias("t"))
    return w.crossJoin(F.broadcast(total)).select("src", "dst", "w", (F.ln("w") - F.ln("t")).alias("log_p"))


def weights(chain: DataFrame, logscale: bool = False) -> DataFrame:
    """(chain_id, k, w) of importance sampling: target over proposal."""
    w = F.col("log_target") - F.col("log_proposal")
    return chain.select("chain_id", "k", (w if logscale else F.exp(w)).alias("w"))


def effective_size(chain: DataFrame) -> DataFrame:
    """(chain_id, ess): squared sum of weights over the sum of squares, with the greatest log weight taken out."""
    lw = weights(chain, True)
    top = lw.groupBy("chain_id").agg(F.max("w").alias("m"))
    x = F.exp(F.col("w") - F.col("m"))
    return lw.join(top, "chain_id").groupBy("chain_id").agg((F.pow(F.sum(x), 2) / F.sum(x * x)).alias("ess"))
