"""Queries over distributions, chains and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bernoulli as bm
from ..operators import graph as g
from ..operators import sampling as sp
from ..sources import fixtures as fx
from .genealogy_plans import T
from .registry import query

CFG = """t AS (SELECT count(*) AS n FROM lineitem), k AS (SELECT CAST((CASE WHEN l_returnflag = 'R' THEN 8 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 4 ELSE 0 END) + (CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END) + (CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS cfg, count(*) AS c FROM lineitem GROUP BY 1),
d AS (SELECT g AS cfg, CAST(coalesce(c, 0) AS DOUBLE) / n AS p FROM t, range(16) r(g) LEFT JOIN k ON k.cfg = r.g),
co AS (SELECT CAST(g AS INTEGER) AS k, CAST(1 << (4 - g) AS BIGINT) AS bit FROM range(1, 5) r(g)), ms AS (SELECT g AS mask FROM range(1, 16) r(g))"""
N = 4


def _d(spark, sf_dir):
    return fx.configurations(spark, sf_dir)


@query(f"WITH {CFG} SELECT cfg, round(p, 6) AS p, CASE WHEN p > 0 THEN round(ln(p), 6) END AS log_p FROM d")
def bm_pdf(spark, sf_dir):
    return bm.pdf(_d(spark, sf_dir)).select("cfg", F.round("p", 6).alias("p"), F.round("log_p", 6).alias("log_p"))


@query(f"WITH {CFG} SELECT CAST(log2(count(*)) AS INTEGER) AS length, bool_and(p >= 0) AND abs(sum(p) - 1) < 1e-9 AS in_support FROM d")
def bm_length(spark, sf_dir):
    return _d(spark, sf_dir).agg(F.log2(F.count(F.lit(1)).cast("double")).cast("int").alias("length"), (F.bool_and(F.col("p") >= 0) & (F.abs(F.sum("p") - 1) < 1e-9)).alias("in_support"))


@query(f"WITH {CFG} SELECT mask, round(sum(CASE WHEN cfg & mask = mask THEN p ELSE 0 END), 6) AS p FROM ms, d GROUP BY mask")
def bm_prob1(spark, sf_dir):
    d = _d(spark, sf_dir)
    return bm.prob_all_one(d, bm.subsets(N, d), N).select("mask", F.round("p", 6).alias("p"))


@query(f"WITH {CFG} SELECT mask, cfg & mask AS cfg, round(sum(p), 6) AS p FROM ms, d GROUP BY ALL")
def bm_marginal(spark, sf_dir):
    d = _d(spark, sf_dir)
    return bm.marginal(d, bm.subsets(N, d), N).select("mask", "cfg", F.round("p", 6).alias("p"))


@query(f"WITH {CFG}, m AS (SELECT k, sum(CASE WHEN cfg & bit <> 0 THEN p ELSE 0 END) AS m FROM co, d GROUP BY k) SELECT k, round(m, 6) AS mean, round(m * (1 - m), 6) AS var FROM m")
def bm_mean(spark, sf_dir):
    return bm.moments(_d(spark, sf_dir), N).select("k", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(f"WITH {CFG}, e AS (SELECT a.k AS i, b.k AS j, sum(CASE WHEN cfg & a.bit <> 0 AND cfg & b.bit <> 0 THEN p ELSE 0 END) AS ij, sum(CASE WHEN cfg & a.bit <> 0 THEN p ELSE 0 END) AS mi, sum(CASE WHEN cfg & b.bit <> 0 THEN p ELSE 0 END) AS mj FROM co a, co b, d GROUP BY ALL) SELECT i, j, round(ij - mi * mj, 6) + 0 AS cov FROM e")
def bm_cov(spark, sf_dir):
    return bm.covariance(_d(spark, sf_dir), N).select("i", "j", (F.round("cov", 6) + F.lit(0)).alias("cov"))


@query(f"WITH {CFG} SELECT round(sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END), 6) AS entropy FROM d")
def bm_entropy(spark, sf_dir):
    return bm.entropy(_d(spark, sf_dir)).select(F.round("entropy", 6).alias("entropy"))


@query(f"WITH {CFG}, u AS (SELECT o_orderkey AS key, (o_orderkey * 7919 % 10007 + 0.5::DOUBLE) / 10007 AS u FROM orders), s AS (SELECT cfg, sum(p) OVER (ORDER BY cfg) AS top, p FROM d WHERE p > 0), b AS (SELECT cfg, top - p AS below, CASE WHEN cfg = (SELECT max(cfg) FROM s) THEN 2 ELSE top END AS top FROM s) SELECT key, cfg FROM u JOIN b ON below <= u AND u < top")
def bm_rand(spark, sf_dir):
    """Configurations drawn with numbers that order keys give."""
    u = (F.col("o_orderkey") * 7919 % 10007 + 0.5) / 10007
    draws = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), u.alias("u"))
    return bm.draw(_d(spark, sf_dir), draws).select("key", "cfg")


@query("SELECT o_custkey % 10 AS chain_id, o_orderkey AS k, round(exp(o_totalprice / 1e5), 6) AS w FROM orders")
def chain_weights(spark, sf_dir):
    return sp.weights(fx.chain(spark, sf_dir)).select("chain_id", "k", F.round("w", 6).alias("w"))


@query("SELECT o_custkey % 10 AS chain_id, round(pow(sum(exp(o_totalprice / 1e5)), 2) / sum(pow(exp(o_totalprice / 1e5), 2)), 3) AS ess FROM orders GROUP BY 1")
def chain_ess(spark, sf_dir):
    return sp.effective_size(fx.chain(spark, sf_dir)).select("chain_id", F.round("ess", 3).alias("ess"))


@query("WITH m AS (SELECT o_custkey, max(o_totalprice / 1e5) AS m FROM orders GROUP BY 1) SELECT o_custkey AS custkey, round(m + ln(sum(exp(o_totalprice / 1e5 - m))), 6) AS lse FROM orders JOIN m USING (o_custkey) GROUP BY o_custkey, m")
def log_sum_exp(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), (F.col("o_totalprice") / 1e5).alias("x"))
    return sp.log_sum_exp(o, ["custkey"], "x").select("custkey", F.round("lse", 6).alias("lse"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice / 1e5 AS x, -ln(-ln((o_orderkey * 7919 % 10007 + 0.5::DOUBLE) / 10007)) AS gm FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY x + gm DESC) AS j, ln(sum(exp(x)) OVER (PARTITION BY o_custkey)) AS lse FROM o) SELECT o_custkey AS custkey, o_orderkey AS orderkey, round(x - lse, 6) AS log_p FROM r WHERE j = 1")
def gumbel_max(spark, sf_dir):
    """One order of each customer, drawn by its price, with numbers that order keys give."""
    u = (F.col("o_orderkey") * 7919 % 10007 + 0.5) / 10007
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), (F.col("o_totalprice") / 1e5).alias("x"), u.alias("u"))
    return sp.gumbel_max(o, ["custkey"], "orderkey", "x", u=F.col("u")).select("custkey", "orderkey", F.round("log_p", 6).alias("log_p"))


@query(f"WITH RECURSIVE {T}, w AS (SELECT src, dst, s.latitude - greatest(d.latitude, 10) AS w FROM te JOIN tv s ON s.v = src JOIN tv d ON d.v = dst WHERE s.latitude > 10) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(w, 6) AS w, round(ln(w) - ln((SELECT sum(w) FROM w)), 6) AS log_p FROM w")
def sample_cedge(spark, sf_dir):
    """Edges to recoalesce on above latitude 10, with their chances."""
    v, e, _ = fx.tree(spark, sf_dir)
    w = sp.edge_weights(g.with_latitudes(e, v), 10.0)
    return w.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("w", 6).alias("w"), F.round("log_p", 6).alias("log_p"))


@query(f"""WITH RECURSIVE {T}, z AS (SELECT max(latitude) AS tm FROM tv), gr AS (SELECT i, CASE WHEN i = 0 THEN 10 ELSE exp(ln(10::DOUBLE) + (ln(tm) - ln(10::DOUBLE)) * i / 25) END AS a, CASE WHEN i = 24 THEN tm ELSE exp(ln(10::DOUBLE) + (ln(tm) - ln(10::DOUBLE)) * (i + 1) / 25) END AS b FROM z, range(25) r(i)),
b AS (SELECT d.latitude AS lo, s.latitude AS hi FROM te JOIN tv s ON s.v = src JOIN tv d ON d.v = dst), c AS (SELECT i, a, b, (SELECT count(*) FROM b x WHERE x.lo <= gr.a AND gr.a <= x.hi) AS n FROM gr),
r AS (SELECT b AS top, n, sum(n * (b - a)) OVER (ORDER BY i) AS run FROM c), q AS (SELECT *, lag(run, 1, -1) OVER (ORDER BY run) AS before FROM r),
u AS (SELECT o_orderkey AS key, -ln(1 - (o_orderkey * 7919 % 10007 + 0.5::DOUBLE) / 10007) * 400000 AS hazard FROM orders)
SELECT key, round(CASE WHEN run IS NOT NULL THEN top + (hazard - run) / q.n ELSE (SELECT tm FROM z) + hazard - (SELECT max(run) FROM r) END, 4) AS clat FROM u LEFT JOIN q ON hazard <= run AND hazard > before""")
def sample_clat(spark, sf_dir):
    """Recoalescence latitudes above 10 for hazards that order keys give."""
    v, e, _ = fx.tree(spark, sf_dir)
    grid = sp.log_grid(10.0, v.agg(F.max("latitude")).first()[0])  # one number
    at = spark.createDataFrame([(x,) for x in grid[:-1]], "latitude double")
    counts = g.live_lineages(e, v, at)
    draws = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (-F.ln(1 - (F.col("o_orderkey") * 7919 % 10007 + 0.5) / 10007) * 400000).alias("hazard"))
    return sp.recoalescence(draws, counts, grid).select("key", F.round("clat", 4).alias("clat"))
