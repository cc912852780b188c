"""Multivariate Bernoulli distributions as tables (cfg, p): 2^n rows, the first coordinate in the highest bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Ranges, materialize, running, unused

#: Coordinates that one grouping sums over.
BITS = 4


def coordinates(n: int, df: DataFrame) -> DataFrame:
    """(k, bit) for coordinates 1 .. n."""
    return df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(n) - F.col("id")).cast("int")).alias("bit"))


def pdf(d: DataFrame) -> DataFrame:
    """(cfg, p, log_p); the log of 0 is null."""
    return d.select("cfg", "p", F.when(F.col("p") > 0, F.ln("p")).alias("log_p"))


def subsets(n: int, d: DataFrame) -> DataFrame:
    """(mask): every non-empty set of coordinates."""
    return d.sparkSession.range(1, 1 << n).select(F.col("id").alias("mask"))


def _blocks(n: int) -> list[list[int]]:
    """The coordinates' bits, highest first, BITS together."""
    return [[1 << k for k in range(top, max(top - BITS, -1), -1)] for top in range(n - 1, -1, -BITS)]


def _patterns(block: list[int]) -> list[int]:
    return [sum(bit for i, bit in enumerate(block) if pick >> i & 1) for pick in range(1 << len(block))]


def prob_all_one(d: DataFrame, masks: DataFrame, n: int) -> DataFrame:
    """(mask, p): the chance that all n or fewer coordinates of the mask are 1; 1 for the empty mask.

    Sums over supersets, coordinate by coordinate: each chance is added to the configurations that lack some of a block's ones, BITS
    coordinates a grouping, combined map-side. n 2^n additions in all, whatever the number of masks, and no pair of mask and configuration.
    """
    run = d.select("cfg", "p")
    for block in _blocks(n):
        all_ = sum(block)
        held = F.filter(F.array(*(F.lit(x).cast("long") for x in _patterns(block))), lambda x: x.bitwiseAND(F.col("cfg")) == x)
        run = run.withColumn("cfg", F.explode(F.transform(held, lambda x: F.col("cfg").bitwiseAND(F.lit(~all_)).bitwiseOR(x)))).groupBy("cfg").agg(F.sum("p").alias("p"))
    return masks.join(run.select(F.col("cfg").alias("mask"), "p"), "mask", "left").select("mask", F.coalesce("p", F.lit(0.0)).alias("p"))


def marginal(d: DataFrame, masks: DataFrame, n: int) -> DataFrame:
    """(mask, cfg, p): the joint distribution of the mask's coordinates (of n), others as 0 in cfg; configurations that d does not have
    are left out.

    Coordinates are kept or summed out BITS at a time; partial masks that no asked mask begins with are dropped, so all 2^n masks take
    the 3^n rows of the result and no more than a few times as many on the way, and a single mask 2^n.
    """
    asked = materialize(masks.select("mask").distinct(), "masks")
    run = d.select(F.lit(0).cast("long").alias("mask"), "cfg", "p")
    done = 0
    for block in _blocks(n):
        done |= sum(block)
        begun = asked.select(F.col("mask").bitwiseAND(F.lit(done).cast("long")).alias("mask")).distinct()
        keep = F.explode(F.array(*(F.lit(x).cast("long") for x in _patterns(block))))
        run = run.withColumn("_keep", keep).withColumn("mask", F.col("mask").bitwiseOR(F.col("_keep"))).join(begun, "mask", "left_semi")
        left = F.col("cfg").bitwiseAND(F.col("_keep").bitwiseOR(F.lit(~sum(block))))
        run = run.withColumn("cfg", left).groupBy("mask", "cfg").agg(F.sum("p").alias("p"))
    return run


def moments(d: DataFrame, n: int) -> DataFrame:
    """(k, mean, var) of each coordinate."""
    m = d.join(F.broadcast(coordinates(n, d))).groupBy("k").agg(F.sum(F.when(F.col("cfg").bitwiseAND(F.col("bit")) != 0, F.col("p")).otherwise(0.0)).alias("mean"))
    return m.select("k", "mean", (F.col("mean") * (1 - F.col("mean"))).alias("var"))


def covariance(d: DataFrame, n: int) -> DataFrame:
    """(i, j, cov) of each pair of coordinates: E[x_i x_j] - m_i m_j."""
    c = coordinates(n, d)
    pairs = c.select(F.col("k").alias("i"), F.col("bit").alias("bi")).join(F.broadcast(c.select(F.col("k").alias("j"), F.col("bit").alias("bj"))))
    on = lambda *bits: F.sum(F.when(F.col("cfg").bitwiseAND(bits[0]) != 0, F.when(F.col("cfg").bitwiseAND(bits[-1]) != 0, F.col("p")).otherwise(0.0)).otherwise(0.0))
    e = d.join(F.broadcast(pairs)).groupBy("i", "j").agg(on(F.col("bi"), F.col("bj")).alias("ij"), on(F.col("bi")).alias("mi"), on(F.col("bj")).alias("mj"))
    return e.select("i", "j", (F.col("ij") - F.col("mi") * F.col("mj")).alias("cov"))


def entropy(d: DataFrame) -> DataFrame:
    """One row (entropy) in nats; zero chances add nothing."""
    return d.agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("entropy"))


def draw(d: DataFrame, draws: DataFrame) -> DataFrame:
    """draws (.., u) with cfg: the first configuration whose running chance exceeds u, the last one from their sum on.

    Chances are summed in blocks of configurations; steps and draws stand in one order, dealt by ranges, and each draw gets the last step
    that begins at or before it. A draw whose u is null gets no configuration.
    """
    at, kind, step = unused([*draws.columns, "cfg"], "_at", "_kind", "_step")
    steps = running(d.where("p > 0").select("cfg", "p"), "cfg", "p", "top").select((F.col("top") - F.col("p")).alias(at), F.lit(0).alias(kind), F.col("cfg").alias(step))
    asked = draws.withColumns({at: F.col("u").cast("double"), kind: F.lit(1)})
    dealt = Ranges(asked.unionByName(steps, allowMissingColumns=True), [], [at, kind, step])
    told = dealt.running(dealt.rows, "cfg", F.col(step), "last").where(F.col(kind) == 1)
    return told.drop(dealt.part, at, kind, step)
