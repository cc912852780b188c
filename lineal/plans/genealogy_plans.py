"""Queries over the tree and the recombination graph of the haplotypes."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import graph as g
from ..operators import mutations as mu
from ..operators import sequences as sq
from ..operators import tables as tb
from ..operators import traversal as tr
from ..operators import validation as va
from ..operators.forest import Forest
from ..operators.storage import materialize
from ..sources import fixtures as fx
from .registry import query
from .sequence_plans import HAP

#: Points on the genome that marginal trees are looked at.
POINTS = (1.2, 20.0, 50.0)

T = """n AS (SELECT count(*) AS n FROM embeddings),
lo AS (SELECT v, b, row_number() OVER (ORDER BY array_to_string(list_transform(b, lambda x: CASE WHEN x THEN '1' ELSE '0' END), ''), v) AS pos FROM (SELECT CAST(vec_id + 1 AS INTEGER) AS v, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings)),
rp AS (SELECT g, g AS cur FROM (SELECT unnest(range(1, 2 * n - 1)) AS g FROM n) UNION ALL SELECT g, 2 * (cur - n) - 1 FROM rp, n WHERE cur > n),
up AS (SELECT g, v, b FROM rp JOIN lo ON cur = pos),
dk AS (SELECT (x.g + 1) // 2 AS k, 1 + len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) AS step FROM up x JOIN up y ON y.g = x.g + 1 WHERE x.g % 2 = 1),
tv AS (SELECT v, 'leaf' AS kind, CAST(0 AS DOUBLE) AS latitude FROM lo UNION ALL SELECT CAST(n + k AS INTEGER), 'coal', CAST(sum(step) OVER (ORDER BY k) AS DOUBLE) FROM dk, n),
te AS (SELECT CAST(n + (g + 1) // 2 AS INTEGER) AS src, CAST(CASE WHEN g <= n THEN v ELSE g END AS INTEGER) AS dst, CAST(0 AS DOUBLE) AS lo, CAST('infinity' AS DOUBLE) AS hi FROM up, n)"""
A = T + """, pr AS (SELECT r, x.v AS a, y.v AS b, len(x.b) AS m, list_filter(list_transform(list_zip(x.b, y.b, range(1, len(x.b) + 1)), lambda z: CASE WHEN z[1] <> z[2] THEN z[3] END), lambda i: i IS NOT NULL) AS d FROM (SELECT unnest(range(1, n // 8 + 1)) AS r FROM n) JOIN lo x ON x.pos = 8 * r - 7 JOIN lo y ON y.pos = 8 * r - 5),
ev AS (SELECT r AS ridx, a, b, 2 * n + 2 * (r - 1) AS rv, 2 * n + 2 * (r - 1) + 1 AS cv, CASE WHEN len(d) = 0 THEN 1 ELSE least(d[1 + r % len(d)], m - 1) END + CAST(0.5 AS DOUBLE) AS bp, n + 4 * r - 3 AS pa, n + 4 * r - 2 AS pb FROM pr, n),
ae AS (SELECT src, dst, lo, hi FROM te WHERE dst NOT IN (SELECT a FROM ev) AND dst NOT IN (SELECT b FROM ev)
  UNION ALL SELECT rv, a, 0, CAST('infinity' AS DOUBLE) FROM ev UNION ALL SELECT pa, rv, 0, bp FROM ev UNION ALL SELECT cv, rv, bp, CAST('infinity' AS DOUBLE) FROM ev UNION ALL SELECT cv, b, 0, CAST('infinity' AS DOUBLE) FROM ev UNION ALL SELECT pb, cv, 0, CAST('infinity' AS DOUBLE) FROM ev),
em AS (SELECT ev.*, least(x.latitude, y.latitude) AS m FROM ev JOIN tv x ON x.v = pa JOIN tv y ON y.v = pb),
av AS (SELECT v, kind, latitude FROM tv UNION ALL SELECT rv, 'rec', 0.25::DOUBLE * m FROM em UNION ALL SELECT cv, 'coal', 0.5::DOUBLE * m FROM em)"""
#: Upward closures: of all vertices of the tree, of the leaves of the graph, and of all vertices of the graph.
UP_T = "WITH RECURSIVE " + T + """, cl AS (SELECT v AS anc, v, 0 AS lvl FROM tv UNION ALL SELECT te.src, cl.v, cl.lvl + 1 FROM cl JOIN te ON te.dst = cl.anc)"""
UP_A = "WITH RECURSIVE " + A + ", " + HAP + """, cl AS (SELECT CAST(v AS BIGINT) AS anc, CAST(v AS BIGINT) AS v, CAST(0 AS DOUBLE) AS lo, CAST('infinity' AS DOUBLE) AS hi, 0 AS lvl FROM av WHERE kind = 'leaf'
  UNION ALL SELECT ae.src, cl.v, greatest(cl.lo, ae.lo), least(cl.hi, ae.hi), cl.lvl + 1 FROM cl JOIN ae ON ae.dst = cl.anc WHERE greatest(cl.lo, ae.lo) < least(cl.hi, ae.hi))"""
SEQ_A = UP_A + """, vs AS (SELECT anc AS v, idx, bool_and(derived) AS derived FROM cl JOIN hap ON hap.v = cl.v AND lo <= idx AND idx < hi GROUP BY anc, idx),
mt AS (SELECT DISTINCT ae.src, ae.dst, s.idx FROM ae JOIN vs s ON s.v = ae.src JOIN vs d ON d.v = ae.dst AND d.idx = s.idx WHERE lo <= s.idx AND s.idx < hi AND s.derived <> d.derived)"""
UP_ALL = "WITH RECURSIVE " + A + """, cl AS (SELECT CAST(v AS BIGINT) AS anc, CAST(v AS BIGINT) AS v FROM av UNION SELECT ae.src, cl.v FROM cl JOIN ae ON ae.dst = cl.anc)"""

class Case:
    """The graph of one query, with what several steps of the query use, made once for it."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.vertices, self.edges, self.events, self.n = fx.graph(spark, sf_dir)

    @cached_property
    def closure(self) -> DataFrame:
        return g.closure(self.edges, self.vertices.where("kind = 'leaf'").select("v"))

    @cached_property
    def sequences(self) -> DataFrame:
        return materialize(mu.vertex_sequences(self.closure, fx.haplotypes(self.spark, self.sf_dir), fx.markers(self.spark, self.sf_dir)), "sequences")

    @cached_property
    def differences(self) -> DataFrame:
        return mu.edge_differences(self.edges, self.sequences, fx.markers(self.spark, self.sf_dir))


def tree_index(spark, sf_dir):
    """(index, n) of the tree."""
    v, e, n = fx.tree(spark, sf_dir)
    return Forest(e, vertices=v), n


def full_closure(spark, sf_dir):
    v, e, _, _ = fx.graph(spark, sf_dir)
    wide = e.withColumns({"lo": F.lit(0.0), "hi": F.lit(g.INF)})
    return g.closure(wide, v.select("v")).select("anc", "v").distinct()


def differences(spark, sf_dir):
    return Case(spark, sf_dir).differences


_X = "x AS (SELECT unnest([1.2::DOUBLE, 20.0::DOUBLE, 50.0::DOUBLE]) AS x)"


# scans and local navigation


@query(f"WITH RECURSIVE {A} SELECT (SELECT count(*) FROM av) AS nv, (SELECT count(*) FROM ae) AS ne, (SELECT count(*) FROM ae) - (SELECT count(*) FROM av) + 1 AS nrec, (SELECT n FROM n) AS n_leaves")
def g_counts(spark, sf_dir):
    v, e, _, n = fx.graph(spark, sf_dir)
    c = v.agg(F.count(F.lit(1)).alias("nv")).crossJoin(e.agg(F.count(F.lit(1)).alias("ne")))
    return c.select("nv", "ne", (F.col("ne") - F.col("nv") + 1).alias("nrec"), F.lit(n).cast("long").alias("n_leaves"))


@query(f"WITH RECURSIVE {A} SELECT src, dst, lo, CASE WHEN hi = 'infinity' THEN NULL ELSE hi END AS hi FROM ae")
def g_edges(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "lo", F.when(F.col("hi") < g.INF, F.col("hi")).alias("hi"))


@query(f"WITH RECURSIVE {A}, d AS (SELECT v, kind, (SELECT count(*) FROM ae WHERE src = v) AS c, (SELECT count(*) FROM ae WHERE dst = v) AS p FROM av) SELECT CAST(v AS BIGINT) AS v, kind, CAST(c AS INTEGER) AS n_children, CAST(p AS INTEGER) AS n_dads, c = 0 AS is_leaf, p = 0 AS is_root, c > 0 AS is_ivertex FROM d")
def g_vertices(spark, sf_dir):
    v, e, _, _ = fx.graph(spark, sf_dir)
    return g.degrees(e, v).select(F.col("v").cast("long").alias("v"), "kind", "n_children", "n_dads", (F.col("n_children") == 0).alias("is_leaf"), (F.col("n_dads") == 0).alias("is_root"), (F.col("n_children") > 0).alias("is_ivertex"))


@query(f"WITH RECURSIVE {A} SELECT (SELECT max(c) FROM (SELECT count(*) c FROM ae GROUP BY src)) AS maxchildren, (SELECT max(c) FROM (SELECT count(*) c FROM ae GROUP BY dst)) AS maxdads")
def maxdads(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    most = lambda c, name: e.groupBy(c).count().agg(F.max("count").alias(name))
    return most("src", "maxchildren").crossJoin(most("dst", "maxdads"))


@query(f"WITH RECURSIVE {A}, q AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT q.src, q.dst, count(*) AS asked, bool_or(ae.src IS NOT NULL) AS has_edge FROM q LEFT JOIN ae ON ae.src = q.src AND ae.dst = q.dst GROUP BY ALL")
def has_edge(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    q = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count(F.lit(1)).alias("asked"))
    there = e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.lit(True).alias("there")).distinct()
    return q.join(there, ["src", "dst"], "left").select("src", "dst", "asked", F.coalesce("there", F.lit(False)).alias("has_edge"))


@query(f"WITH RECURSIVE {A} SELECT CAST(v AS BIGINT) AS v, round(latitude, 6) AS latitude FROM av")
def latitudes(spark, sf_dir):
    v, _, _, _ = fx.graph(spark, sf_dir)
    return v.select(F.col("v").cast("long").alias("v"), F.round("latitude", 6).alias("latitude"))


def _ends(what, near, far):
    return f"WITH RECURSIVE {A} SELECT CAST(v AS BIGINT) AS v, coalesce(min({far}), 0) AS {what}, string_agg(CAST({far} AS VARCHAR), ',' ORDER BY {far}) AS all_{what} FROM av LEFT JOIN ae ON ae.{near} = v GROUP BY v"


def _neighbours(spark, sf_dir, what, near, far):
    v, e, _, _ = fx.graph(spark, sf_dir)
    per = e.groupBy(F.col(near).alias("v")).agg(F.min(far).alias("m"), F.array_join(F.array_sort(F.collect_list(far)).cast("array<string>"), ",").alias(f"all_{what}"))
    return v.select("v").join(per, "v", "left").select(F.col("v").cast("long").alias("v"), F.coalesce("m", F.lit(0)).cast("long").alias(what), f"all_{what}")


@query(_ends("dad", "dst", "src"))
def dads(spark, sf_dir):
    return _neighbours(spark, sf_dir, "dad", "dst", "src")


@query(_ends("child", "src", "dst"))
def children(spark, sf_dir):
    return _neighbours(spark, sf_dir, "child", "src", "dst")


@query(f"WITH RECURSIVE {A}, {_X} SELECT x, CAST(dst AS BIGINT) AS v, CAST(src AS BIGINT) AS dad FROM ae, x WHERE lo <= x AND x < hi")
def dads_marginal(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return g.at_points(e, POINTS).select("x", F.col("dst").cast("long").alias("v"), F.col("src").cast("long").alias("dad"))


@query(f"WITH RECURSIVE {A} SELECT CAST(src AS BIGINT) AS v, CAST(dst AS BIGINT) AS child FROM ae WHERE lo < 30 AND hi > 10")
def children_marginal(spark, sf_dir):
    """Children by edges that overlap [10, 30)."""
    _, e, _, _ = fx.graph(spark, sf_dir)
    return e.where(g.meets(10.0, 30.0)).select(F.col("src").cast("long").alias("v"), F.col("dst").cast("long").alias("child"))


@query(f"WITH RECURSIVE {A} SELECT CAST(b.dst AS BIGINT) AS v, CAST(a.src AS BIGINT) AS dad, CAST(a.dst AS BIGINT) AS sibling FROM ae a JOIN ae b ON a.src = b.src AND a.dst <> b.dst")
def siblings(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return g.siblings(e).select(*(F.col(c).cast("long").alias(c) for c in ("v", "dad", "sibling")))


@query(f"WITH RECURSIVE {T} SELECT CAST(v AS BIGINT) AS v, CAST(coalesce(min(a.dst), 0) AS BIGINT) AS sibling FROM tv LEFT JOIN te b ON b.dst = v LEFT JOIN te a ON a.src = b.src AND a.dst <> v GROUP BY v")
def sibling(spark, sf_dir):
    v, e, _ = fx.tree(spark, sf_dir)
    s = g.siblings(e).groupBy("v").agg(F.min("sibling").alias("s"))
    return v.select("v").join(s, "v", "left").select(F.col("v").cast("long").alias("v"), F.coalesce("s", F.lit(0)).cast("long").alias("sibling"))


@query(f"WITH RECURSIVE {A} SELECT CAST(e.src AS BIGINT) AS src, CAST(e.dst AS BIGINT) AS dst, CAST(coalesce(min(o.src), e.src) AS BIGINT) AS other FROM ae e LEFT JOIN ae o ON o.dst = e.dst AND o.src <> e.src GROUP BY e.src, e.dst")
def otherdad(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return g.other_dad(e).select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst", "other")))


def _skip(near, far):
    return f"""WITH RECURSIVE {A}, u AS (SELECT {near} AS v, min({far}) AS nxt FROM ae GROUP BY {near} HAVING count(DISTINCT {far}) = 1),
w AS (SELECT DISTINCT {near} AS v, {far} AS t FROM ae UNION ALL SELECT w.v, u.nxt FROM w JOIN u ON w.t = u.v)
SELECT DISTINCT CAST(v AS BIGINT) AS v, CAST(t AS BIGINT) AS t FROM w WHERE t NOT IN (SELECT v FROM u)"""


@query(_skip("src", "dst"))
def children3(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return g.skip_unary(e, "children").select(F.col("v").cast("long").alias("v"), F.col("to").cast("long").alias("t"))


@query(_skip("dst", "src"))
def dads3(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return g.skip_unary(e, "dads").select(F.col("v").cast("long").alias("v"), F.col("to").cast("long").alias("t"))


@query(f"WITH RECURSIVE {A} SELECT CAST(ridx AS INTEGER) AS ridx, CAST(rv AS BIGINT) AS rvertex, bp AS breakpoint, CAST((rv - 2 * (n - 1)) // 2 AS BIGINT) AS rec_ordinal, CAST(CASE WHEN cv > 2 * n THEN cv - (cv - 2 * (n - 1)) // 2 ELSE cv END - n AS BIGINT) AS coal_ordinal, cv % 2 = 1 AS cv_is_coalescence FROM ev, n")
def recombinations(spark, sf_dir):
    """Recombination vertices with breakpoints, and the ordinals that vertex numbers stand for."""
    _, _, ev, n = fx.graph(spark, sf_dir)
    o = lambda c: F.floor((F.col(c) - 2 * (n - 1)) / 2)
    coal = F.when(F.col("cvertex") > 2 * n, F.col("cvertex") - o("cvertex")).otherwise(F.col("cvertex")) - n
    return ev.select("ridx", F.col("rvertex").cast("long").alias("rvertex"), "breakpoint", o("rvertex").alias("rec_ordinal"), coal.cast("long").alias("coal_ordinal"), (F.col("cvertex") % 2 == 1).alias("cv_is_coalescence"))


@query(f"WITH RECURSIVE {A} SELECT count(*) AS total, count(*) FILTER (bp >= 10 AND bp < 30) AS within FROM ev")
def nrecombinations(spark, sf_dir):
    _, _, ev, _ = fx.graph(spark, sf_dir)
    return ev.agg(F.count(F.lit(1)).alias("total"), F.count_if((F.col("breakpoint") >= 10) & (F.col("breakpoint") < 30)).alias("within"))


@query(f"WITH RECURSIVE {A} SELECT CAST(pa AS BIGINT) AS src, CAST(rv AS BIGINT) AS dst, 0::DOUBLE AS side_lo, bp AS side_hi FROM ev UNION ALL SELECT cv, rv, bp, NULL FROM ev")
def recombination_mask(spark, sf_dir):
    _, e, ev, _ = fx.graph(spark, sf_dir)
    return g.event_rules(ev, e).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "side_lo", "side_hi")


@query(f"WITH RECURSIVE {A}, c AS (SELECT src AS v, lo, hi, max(hi) OVER (PARTITION BY src ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT DISTINCT src, lo, hi FROM ae)), i AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM c), u AS (SELECT v, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY v, k UNION ALL SELECT v, 0, CAST('infinity' AS DOUBLE) FROM av WHERE kind = 'leaf') SELECT CAST(v AS BIGINT) AS v, lo, CASE WHEN hi < 'infinity' THEN hi END AS hi FROM u")
def ancestral_intervals(spark, sf_dir):
    v, e, _, _ = fx.graph(spark, sf_dir)
    return g.vertex_intervals(e, v).select(F.col("v").cast("long").alias("v"), "lo", F.when(F.col("hi") < g.INF, F.col("hi")).alias("hi"))


@query(f"WITH RECURSIVE {A} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, row_number() OVER (ORDER BY src, dst) AS number FROM ae")
def edgesmap(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return mu.edgesmap(e).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "number")


@query(f"WITH RECURSIVE {A} SELECT CAST(e.src AS BIGINT) AS src, CAST(e.dst AS BIGINT) AS dst FROM ae e JOIN av s ON s.v = e.src WHERE e.lo < 30 AND e.hi > 10 AND s.latitude >= 5")
def edges_interval(spark, sf_dir):
    """Edges that overlap [10, 30) and whose upper end is at latitude 5 or above."""
    v, e, _, _ = fx.graph(spark, sf_dir)
    return g.with_latitudes(e, v).where(g.meets(10.0, 30.0) & (F.col("src_lat") >= 5)).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


# closures


@query(f"{UP_T} SELECT CAST(v AS BIGINT) AS v, max(lvl) AS depth FROM cl GROUP BY v")
def depth(spark, sf_dir):
    index, _ = tree_index(spark, sf_dir)
    return index.nodes.select(F.col("v").cast("long").alias("v"), F.col("depth").cast("int").alias("depth"))


@query(f"{UP_T}, d AS (SELECT v, max(lvl) AS depth FROM cl GROUP BY v) SELECT CAST(v AS BIGINT) AS v, row_number() OVER (ORDER BY depth, v) AS place FROM d WHERE v <= (SELECT n FROM n)")
def leaves_permutation(spark, sf_dir):
    """Leaves by depth, then number: places within a depth, offset by the counts of lesser depths."""
    index, n = tree_index(spark, sf_dir)
    d = index.nodes.where(F.col("v") <= n).select("v", "depth", F.floor(F.col("v") / 4096).alias("part"))
    counts = d.groupBy("depth", "part").count()
    off = counts.select("depth", "part", (F.sum("count").over(Window.orderBy("depth", "part")) - F.col("count")).alias("off"))
    k = F.row_number().over(Window.partitionBy("depth", "part").orderBy("v"))
    return d.withColumn("k", k).join(off, ["depth", "part"]).select(F.col("v").cast("long").alias("v"), (F.col("off") + F.col("k")).alias("place"))


@query(f"{UP_T} SELECT CAST(anc AS BIGINT) AS v, count(*) AS n_leaves, CAST(min(v) AS BIGINT) AS first_leaf, CAST(max(v) AS BIGINT) AS last_leaf FROM cl WHERE v <= (SELECT n FROM n) GROUP BY anc")
def descendants_leaves(spark, sf_dir):
    index, _ = tree_index(spark, sf_dir)
    return index.nodes.select(F.col("v").cast("long").alias("v"), "n_leaves", F.col("first_leaf").cast("long").alias("first_leaf"), F.col("last_leaf").cast("long").alias("last_leaf"))


@query(f"{UP_ALL} SELECT v, count(*) AS n, CAST(sum(anc) AS BIGINT) AS total FROM cl WHERE anc <> v GROUP BY v")
def ancestors(spark, sf_dir):
    c = full_closure(spark, sf_dir).where("anc <> v")
    return c.groupBy(F.col("v").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("anc").alias("total"))


@query(f"{UP_ALL} SELECT anc AS v, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM cl WHERE anc <> v GROUP BY anc")
def descendants(spark, sf_dir):
    c = full_closure(spark, sf_dir).where("anc <> v")
    return c.groupBy(F.col("anc").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).select("v", "n", "total")


@query(f"{UP_A}, {_X} SELECT x, anc AS v, count(DISTINCT cl.v) AS n_leaves FROM cl, x WHERE lvl > 0 AND lo <= x AND x < hi GROUP BY x, anc")
def descendants_marginal(spark, sf_dir):
    c = g.at_points(Case(spark, sf_dir).closure.where("lvl > 0"), POINTS)
    return c.select("x", F.col("anc").cast("long").alias("a"), "v").distinct().groupBy("x", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n_leaves"))


@query(f"{UP_A}, {_X}, st AS (SELECT v AS id, unnest([v, v + 7]) AS leaf FROM av WHERE kind = 'leaf' AND v + 7 <= (SELECT n FROM n)), c AS (SELECT id, x, anc FROM st JOIN cl ON cl.v = st.leaf, x WHERE lvl > 0 AND lo <= x AND x < hi GROUP BY id, x, anc HAVING count(DISTINCT leaf) = 2) SELECT CAST(id AS BIGINT) AS set_id, x, CAST(arg_min(anc, latitude) AS BIGINT) AS mrca, round(min(latitude), 6) AS tmrca FROM c JOIN av ON av.v = anc GROUP BY id, x")
def mrca_set(spark, sf_dir):
    """Lowest common ancestor of leaves v and v + 7 in three marginal trees."""
    c = Case(spark, sf_dir)
    sets = spark.range(1, max(1, c.n - 6)).select(F.col("id").alias("set_id"), F.explode(F.array(F.col("id"), F.col("id") + 7)).alias("v")).select("set_id", F.col("v").cast("int").alias("v"))
    trees = Forest(g.at_points(c.edges, POINTS).select("x", "src", "dst"), ["x"])
    out = trees.lowest_above(sets).join(c.vertices.select(F.col("v").alias("mrca"), "latitude"), "mrca")
    return out.select("set_id", "x", F.col("mrca").cast("long").alias("mrca"), F.round("latitude", 6).alias("tmrca"))


_GRID = "gr AS (SELECT 0::DOUBLE AS x UNION SELECT bp FROM ev)"
_TM = f"tm AS (SELECT x, min(latitude) AS tmrca FROM (SELECT x, anc FROM cl, gr WHERE lvl > 0 AND lo <= x AND x < hi GROUP BY x, anc HAVING count(DISTINCT cl.v) = (SELECT n FROM n)) q JOIN av ON av.v = anc GROUP BY x)"


@query(f"{UP_A}, {_GRID}, {_TM} SELECT x, round(tmrca, 6) AS tmrca FROM tm")
def tmrca_curve(spark, sf_dir):
    c = Case(spark, sf_dir)
    grid = c.events.select(F.col("breakpoint").alias("x")).unionByName(spark.range(1).select(F.lit(0.0).alias("x"))).distinct()
    return g.root_times(c.closure, c.n, grid, c.vertices).select("x", F.round("tmrca", 6).alias("tmrca"))


@query(f"WITH RECURSIVE {T} SELECT CAST(max(v) AS BIGINT) AS mrca, round(max(latitude), 6) AS tmrca FROM tv")
def tmrca(spark, sf_dir):
    v, e, _ = fx.tree(spark, sf_dir)
    root = v.join(e.select(F.col("dst").alias("v")), "v", "left_anti")
    return root.select(F.col("v").cast("long").alias("mrca"), F.round("latitude", 6).alias("tmrca"))


# lengths and lineages


@query(f"WITH RECURSIVE {A} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(s.latitude - d.latitude, 6) AS length FROM ae JOIN av s ON s.v = src JOIN av d ON d.v = dst")
def branchlength_edges(spark, sf_dir):
    v, e, _, _ = fx.graph(spark, sf_dir)
    return g.with_latitudes(e, v).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round(F.col("src_lat") - F.col("dst_lat"), 6).alias("length"))


@query(f"WITH RECURSIVE {A}, ak AS (SELECT ae.*, s.kind AS sk, s.latitude - d.latitude AS len FROM ae JOIN av s ON s.v = src JOIN av d ON d.v = dst), td AS (SELECT src, dst, len FROM ak, n WHERE src = 2 * n - 1 AND lo < 30 AND hi > 10 UNION SELECT ak.src, ak.dst, ak.len FROM td JOIN ak ON ak.src = td.dst WHERE (lo < 30 AND hi > 10) OR sk = 'rec') SELECT (SELECT round(sum(len), 4) FROM ak) AS total, round(sum(len), 4) AS within FROM td")
def branchlength(spark, sf_dir):
    """Total length, and that of the edges at [10, 30) below the highest vertex."""
    v, e, _, n = fx.graph(spark, sf_dir)
    k = materialize(tr.with_kinds(e, v))
    length = F.col("src_lat") - F.col("dst_lat")
    some = tr.edges_down(k, 2 * n - 1, g.meets(10.0, 30.0)).select("src", "dst").join(k, ["src", "dst"])
    return k.agg(F.round(F.sum(length), 4).alias("total")).crossJoin(some.agg(F.round(F.sum(length), 4).alias("within")))


@query(f"WITH RECURSIVE {A}, l AS (SELECT DISTINCT o_totalprice / 20 AS latitude FROM orders), t AS (SELECT max(latitude) AS tm FROM av), b AS (SELECT d.latitude AS lo, s.latitude AS hi FROM ae JOIN av s ON s.v = src JOIN av d ON d.v = dst) SELECT round(latitude, 6) AS latitude, CAST((SELECT count(*) FROM b WHERE b.lo <= l.latitude AND l.latitude <= b.hi) + CASE WHEN latitude > tm THEN 1 ELSE 0 END AS INTEGER) AS n FROM l, t")
def nlive(spark, sf_dir):
    v, e, _, _ = fx.graph(spark, sf_dir)
    at = fx.table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 20).alias("latitude")).distinct()
    return g.live_lineages(e, v, at).select(F.round("latitude", 6).alias("latitude"), "n")


@query(f"WITH RECURSIVE {A}, t AS (SELECT max(latitude) AS tm FROM av), b AS (SELECT CAST(least(floor(latitude / tm * 20), 19) AS INTEGER) AS bin FROM av, t WHERE kind <> 'leaf') SELECT bin, count(*) AS n FROM b GROUP BY bin")
def hist_latitudes(spark, sf_dir):
    v, _, _, _ = fx.graph(spark, sf_dir)
    top = v.agg(F.max("latitude").alias("tm"))
    bin_ = F.least(F.floor(F.col("latitude") / F.col("tm") * 20), F.lit(19)).cast("int")
    return v.where("kind <> 'leaf'").crossJoin(F.broadcast(top)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {A}, k AS (SELECT greatest(1, least(69, count(*) // 100)) AS nb FROM ev), b AS (SELECT unnest(range(0, nb)) AS bin, nb FROM k), c AS (SELECT CAST(least(floor(bp / 64 * nb), nb - 1) AS BIGINT) AS bin FROM ev, k) SELECT CAST(b.bin AS BIGINT) AS bin, count(c.bin) AS n FROM b LEFT JOIN c ON c.bin = b.bin GROUP BY b.bin")
def hist_breakpoints(spark, sf_dir):
    _, _, ev, n = fx.graph(spark, sf_dir)
    nb = max(1, min(69, (n // 8) // 100))
    c = ev.select(F.least(F.floor(F.col("breakpoint") / fx.MARKERS * nb), F.lit(nb - 1)).cast("long").alias("bin")).groupBy("bin").count()
    return spark.range(nb).select(F.col("id").alias("bin")).join(c, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


@query(f"WITH {HAP}, l AS (SELECT v, max(idx) AS m FROM hap GROUP BY v), k AS (SELECT v, m, unnest([greatest(1, least(69, m)), 10]) AS bins FROM l), c AS (SELECT v, bins, idx - 1 AS i, m // bins AS q, m % bins AS r, derived FROM hap JOIN k USING (v)) SELECT v, CAST(bins AS INTEGER) AS bins, CAST(CASE WHEN i < r * (q + 1) THEN i // (q + 1) ELSE r + (i - r * (q + 1)) // q END AS INTEGER) AS bin, sum(derived::int)::BIGINT AS n FROM c GROUP BY ALL")
def binned_markers(spark, sf_dir):
    """Derived markers by bin: as many bins as markers, 69 at most, and ten."""
    h = fx.haplotypes(spark, sf_dir)
    return sq.binned(h, F.greatest(F.lit(1), F.least(F.lit(69), F.col("n")))).unionByName(sq.binned(h, F.lit(10)))


# sequences and mutations


@query(f"{SEQ_A} SELECT v, idx, derived FROM vs")
def compute_sequence(spark, sf_dir):
    c = Case(spark, sf_dir)
    return mu.long_sequences(c.sequences).select(F.col("v").cast("long").alias("v"), "idx", "derived")


@query(f"{SEQ_A} SELECT src, dst, count(*) AS n FROM mt GROUP BY src, dst")
def nmutations_edge(spark, sf_dir):
    d = differences(spark, sf_dir)
    return d.groupBy(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).agg(F.sum(F.bit_count("x")).cast("long").alias("n")).where("n > 0")


@query(f"{SEQ_A} SELECT count(*) AS n FROM mt")
def nmutations(spark, sf_dir):
    return differences(spark, sf_dir).agg(F.sum(F.bit_count("x")).cast("long").alias("n"))


@query(f"{SEQ_A} SELECT idx, src, dst FROM mt")
def mutation_edges_all(spark, sf_dir):
    return mu.mutation_edges(differences(spark, sf_dir)).select("idx", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"{SEQ_A} SELECT idx, src, dst FROM mt WHERE 10 <= idx AND idx < 30")
def mutation_edges_interval(spark, sf_dir):
    return mutation_edges_all(spark, sf_dir).where("10 <= idx and idx < 30")


@query(f"{SEQ_A} SELECT DISTINCT ae.src, ae.dst FROM ae JOIN vs s ON s.v = ae.src JOIN vs d ON d.v = ae.dst AND d.idx = s.idx WHERE s.idx = 33 AND lo <= 33 AND 33 < hi AND d.derived AND NOT s.derived")
def mutation_edges_marker(spark, sf_dir):
    """Edges of the tree at marker 33 on which the derived state arises."""
    bit = lambda c: F.call_function("shiftrightunsigned", F.col(c), F.lit(32)).bitwiseAND(F.lit(1).cast("long")) == 1
    c = Case(spark, sf_dir)
    s, e = c.sequences.where("chunk = 0"), c.edges
    up, low = s.select(F.col("v").alias("src"), F.col("bits").alias("a")), s.select(F.col("v").alias("dst"), F.col("bits").alias("b"))
    return e.where(g.covers(33.0)).join(up, "src").join(low, "dst").where(bit("b") & ~bit("a")).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"{SEQ_A}, k AS (SELECT * FROM mt WHERE src NOT IN (SELECT rv FROM ev)), f AS (SELECT min(idx) AS idx FROM (SELECT idx FROM k GROUP BY idx HAVING count(*) > 1)) SELECT k.idx, src, dst FROM k JOIN f ON f.idx = k.idx")
def next_inconsistent_idx(spark, sf_dir):
    c = Case(spark, sf_dir)
    return mu.next_inconsistent(mu.mutation_edges(c.differences), c.events).select("idx", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"WITH {HAP}, df AS (SELECT a.v, a.idx FROM hap a JOIN hap b ON b.v = a.v + 1 AND b.idx = a.idx WHERE a.derived <> b.derived), p AS (SELECT v, CAST(v % 64 + 1 AS INTEGER) AS r FROM hap WHERE idx = 1) SELECT p.v, r AS right_idx, CAST(coalesce((SELECT max(idx) FROM df WHERE df.v = p.v AND df.idx < r), 0) AS INTEGER) AS left_idx FROM p")
def breakpoint_bounds(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    from ..operators.sequences import neighbours

    x = neighbours(h).select("v", F.posexplode(bits.unpack(bits.xor_(F.col("a"), F.col("b")), F.col("n"))).alias("p", "differs"))
    differing = x.where("differs").select(F.col("v").alias("pair"), (F.col("p") + 1).alias("idx"))
    pairs = h.select(F.col("v").alias("pair"), (F.col("v") % 64 + 1).cast("int").alias("right_idx"))
    return mu.breakpoint_bounds(pairs, differing).select(F.col("pair").alias("v"), "right_idx", "left_idx")


@query(f"{SEQ_A}, d AS (SELECT av.v, kind, latitude, coalesce(bool_or(derived), false) AS is_derived FROM av LEFT JOIN vs ON vs.v = av.v AND 10 <= idx AND idx < 30 GROUP BY ALL) SELECT CAST(v AS BIGINT) AS v, kind, round(latitude, 6) AS latitude, is_derived, kind = 'leaf' OR EXISTS (SELECT 1 FROM ae WHERE src = v AND lo < 30 AND hi > 10) AS visible FROM d")
def plot_genealogy(spark, sf_dir):
    """Vertices as a plot of [10, 30) draws them: coloured if derived anywhere there, hidden if inner and not ancestral there."""
    c = Case(spark, sf_dir)
    v = c.vertices
    on = mu.long_sequences(c.sequences).where("10 <= idx and idx < 30").groupBy("v").agg(F.bool_or("derived").alias("is_derived"))
    seen = c.edges.where(g.meets(10.0, 30.0)).select(F.col("src").alias("v")).distinct().withColumn("seen", F.lit(True))
    told = v.join(on, "v", "left").join(seen, "v", "left")
    return told.select(F.col("v").cast("long").alias("v"), "kind", F.round("latitude", 6).alias("latitude"), F.coalesce("is_derived", F.lit(False)).alias("is_derived"), ((F.col("kind") == "leaf") | F.col("seen").isNotNull()).alias("visible"))


@query(f"WITH RECURSIVE {A} SELECT 'graph' AS what, (SELECT n FROM n) AS leaves, CAST(64 AS BIGINT) AS markers, (SELECT count(*) FROM ev) AS recombinations, (SELECT round(max(latitude), 6) FROM av) AS tmrca")
def show_genealogy(spark, sf_dir):
    v, _, ev, n = fx.graph(spark, sf_dir)
    m = fx.markers(spark, sf_dir).agg(F.count(F.lit(1)).alias("markers"))
    return v.agg(F.max("latitude").alias("t")).crossJoin(ev.agg(F.count(F.lit(1)).alias("recombinations"))).crossJoin(m).select(F.lit("graph").alias("what"), F.lit(n).cast("long").alias("leaves"), "markers", "recombinations", F.round("t", 6).alias("tmrca"))


# validation and export


def _degrees(name, v, e):
    return f"{name} AS (SELECT v, kind, (SELECT count(*) FROM {e} x WHERE x.src = y.v) AS c, (SELECT count(*) FROM {e} x WHERE x.dst = y.v) AS p FROM {v} y)"


def _rules(which, rules, counts):
    return " UNION ALL ".join(f"SELECT '{which}' AS which, '{rule}' AS rule, (SELECT count(*) FROM {count}) AS violations" for rule, count in zip(rules, counts, strict=True))


def _tree_rules(which, v, e, d):
    lat = f"(SELECT s.latitude AS sl, x.latitude AS dl FROM {e} z JOIN {v} s ON s.v = z.src JOIN {v} x ON x.v = z.dst)"
    return _rules(which, va.TREE_RULES, (f"{v} x JOIN {v} y ON y.v = x.v + 1 WHERE x.kind = 'coal' AND y.kind = 'coal' AND y.latitude < x.latitude", f"{lat} WHERE dl > sl", f"{e} WHERE dst >= src", f"{d} WHERE p = 0 AND c <> 2", f"{d} WHERE kind = 'coal' AND p > 0 AND (c <> 2 OR p <> 1)", f"{d} WHERE kind = 'leaf' AND (c <> 0 OR p <> 1)", f"(SELECT count(*) AS k FROM {d} WHERE p = 0) WHERE k <> 1"))


#: Damage: lowered vertices, lost edges, one edge too many and one upside down.
_BAD_T = """bv AS (SELECT v, kind, CASE WHEN kind = 'coal' AND v % 40 = 0 THEN latitude / 2 ELSE latitude END AS latitude FROM tv),
be AS (SELECT src, dst FROM te WHERE dst % 50 <> 7 UNION ALL SELECT 2 * n - 1, 5 FROM n UNION ALL SELECT n + 1, n + 3 FROM n)"""


@query(f"WITH RECURSIVE {T}, {_BAD_T}, {_degrees('td', 'tv', 'te')}, {_degrees('bd', 'bv', 'be')} {_tree_rules('intact', 'tv', 'te', 'td')} UNION ALL {_tree_rules('damaged', 'bv', 'be', 'bd')}")
def validate_tree(spark, sf_dir):
    """Broken rules of the tree, and of a damaged one."""
    v, e, n = fx.tree(spark, sf_dir)
    v, e = materialize(v), materialize(e.select("src", "dst"))
    bad_v = v.withColumn("latitude", F.when((F.col("kind") == "coal") & (F.col("v") % 40 == 0), F.col("latitude") / 2).otherwise(F.col("latitude")))
    more = spark.createDataFrame([(2 * n - 1, 5), (n + 1, n + 3)], "src int, dst int")
    bad_e = e.where("dst % 50 <> 7").unionByName(more)
    return va.tree_violations(v, e).withColumn("which", F.lit("intact")).unionByName(va.tree_violations(bad_v, bad_e).withColumn("which", F.lit("damaged")))


def _islands(name, source):
    return f"""{name}0 AS (SELECT v, lo, hi, max(hi) OVER (PARTITION BY v ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ({source})), {name}1 AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM {name}0 WHERE lo < hi), {name} AS (SELECT v, min(lo) AS lo, max(hi) AS hi FROM {name}1 GROUP BY v, k)"""


def _graph_parts(p, v, e):
    inner = f"SELECT v FROM {v} WHERE kind = 'coal' AND v IN (SELECT dst FROM {e})"
    return f"""{_degrees(p + 'd', v, e)}, {_islands(p + 'b', f"SELECT DISTINCT src AS v, lo, hi FROM {e}")}, {_islands(p + 'a', f"SELECT DISTINCT dst AS v, lo, hi FROM {e}")},
{p}u AS ((SELECT * FROM {p}b WHERE v IN ({inner}) EXCEPT SELECT * FROM {p}a) UNION ALL (SELECT * FROM {p}a WHERE v IN ({inner}) EXCEPT SELECT * FROM {p}b)),
{p}w AS (SELECT x.src AS v, m.idx, bool_and(coalesce(c.derived, false)) AS want FROM {e} x JOIN m ON x.lo <= m.idx AND m.idx < x.hi LEFT JOIN vs c ON c.v = x.dst AND c.idx = m.idx GROUP BY x.src, m.idx),
{p}s AS (SELECT DISTINCT w.v FROM {p}w w LEFT JOIN vs s ON s.v = w.v AND s.idx = w.idx WHERE coalesce(s.derived, false) <> want)"""


def _graph_rules(which, p, v, e, flipped, mutations):
    lat = f"(SELECT s.latitude AS sl, x.latitude AS dl FROM {e} z JOIN {v} s ON s.v = z.src JOIN {v} x ON x.v = z.dst)"
    return _rules(which, va.GRAPH_RULES, (f"{p}d WHERE kind = 'leaf' AND (c <> 0 OR p <> 1)", f"{e} JOIN {v} x ON x.v = dst WHERE kind = 'leaf' AND (lo <> 0 OR hi <> 'infinity')", f"{p}d WHERE kind = 'coal' AND (c <> 2 OR p > 1)", f"{p}d WHERE kind = 'rec' AND (c <> 1 OR p <> 2)", f"{lat} WHERE dl > sl", f"{p}u", f"{p}s", flipped, f"(SELECT m.idx FROM m LEFT JOIN ({mutations}) q ON q.idx = m.idx GROUP BY m.idx HAVING count(q.idx) <> 1)", f"(SELECT count(*) AS k FROM {p}d WHERE p = 0) WHERE k <> 1"))


#: Damage: lowered vertices, lost edges, shortened intervals; complemented haplotypes and lost mutations.
_BAD_A = """wv AS (SELECT v, kind, CASE WHEN kind = 'coal' AND v % 40 = 0 THEN latitude / 2 ELSE latitude END AS latitude FROM av),
we AS (SELECT src, dst, lo, CASE WHEN (src + dst) % 37 = 0 AND lo < 40 THEN least(hi, 40) ELSE hi END AS hi FROM ae WHERE dst % 50 <> 7), m AS (SELECT unnest(range(1, 65)) AS idx)"""


@query(f"""{SEQ_A}, {_BAD_A}, {_graph_parts('ok_', 'av', 'ae')}, {_graph_parts('bad_', 'wv', 'we')} {_graph_rules('intact', 'ok_', 'av', 'ae', 'n WHERE false', 'SELECT idx FROM mt')} UNION ALL {_graph_rules('damaged', 'bad_', 'wv', 'we', '"lo" WHERE v % 30 = 0', 'SELECT idx FROM mt WHERE idx % 3 <> 0 OR dst % 2 = 0')}""")
def validate_arg(spark, sf_dir):
    """Broken rules of the graph, and of a damaged one with the sequences of the whole one."""
    c = Case(spark, sf_dir)
    v, e, h, m = materialize(c.vertices), materialize(c.edges), fx.haplotypes(spark, sf_dir), fx.markers(spark, sf_dir)
    muts = materialize(mu.mutation_edges(c.differences))
    bad_v = v.withColumn("latitude", F.when((F.col("kind") == "coal") & (F.col("v") % 40 == 0), F.col("latitude") / 2).otherwise(F.col("latitude")))
    cut = ((F.col("src") + F.col("dst")) % 37 == 0) & (F.col("lo") < 40)
    bad_e = e.where("dst % 50 <> 7").withColumn("hi", F.when(cut, F.least("hi", F.lit(40.0))).otherwise(F.col("hi")))
    bad_h = h.withColumn("chunks", F.when(F.col("v") % 30 == 0, bits.not_(F.col("chunks"), F.col("n"))).otherwise(F.col("chunks")))
    one = va.graph_violations(v, e, c.sequences, muts, h, m).withColumn("which", F.lit("intact"))
    return one.unionByName(va.graph_violations(bad_v, bad_e, c.sequences, muts.where("idx % 3 <> 0 or dst % 2 = 0"), bad_h, m).withColumn("which", F.lit("damaged")))


@query(f"WITH RECURSIVE {A} SELECT CAST(v - 1 AS BIGINT) AS id, CASE WHEN kind = 'leaf' THEN 1 ELSE 0 END AS flags, round(latitude, 6) AS time FROM av")
def ts_nodes(spark, sf_dir):
    v, _, _, _ = fx.graph(spark, sf_dir)
    return tb.nodes(v).select(F.col("id").cast("long").alias("id"), "flags", F.round("time", 6).alias("time"))


@query(f"WITH RECURSIVE {A} SELECT lo AS \"left\", least(hi, 64) AS \"right\", CAST(src - 1 AS BIGINT) AS parent, CAST(dst - 1 AS BIGINT) AS child FROM ae")
def ts_edges(spark, sf_dir):
    _, e, _, _ = fx.graph(spark, sf_dir)
    return tb.edges(e, float(fx.MARKERS)).select("left", "right", F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child"))


@query(f"WITH {HAP} SELECT DISTINCT idx - 1 AS id, CAST(idx AS DOUBLE) AS position, '0' AS ancestral_state FROM hap")
def ts_sites(spark, sf_dir):
    return tb.sites(fx.markers(spark, sf_dir))


@query(f"{SEQ_A} SELECT CAST(idx - 1 AS INTEGER) AS site, CAST(dst - 1 AS BIGINT) AS node, '1' AS derived_state FROM mt")
def ts_mutations(spark, sf_dir):
    return tb.mutations(mu.mutation_edges(differences(spark, sf_dir))).select("site", F.col("node").cast("long").alias("node"), "derived_state")


@query(f"WITH {HAP} SELECT v, idx, derived, 2e-8::DOUBLE AS rate, 64::DOUBLE AS sequence_length, 500::DOUBLE AS population_size, NULL::DOUBLE AS recombination_rate FROM hap WHERE idx IN (SELECT idx FROM hap GROUP BY idx HAVING bool_or(derived))")
def sample_from_treesequence(spark, sf_dir):
    """Genotypes back from exported tables with provenance, written and read as Parquet. Mutations stand on all levels of the tree,
    on edges whose ends' states differ and above a derived root, so a leaf's state is told by its whole path."""
    v, e, _ = fx.tree(spark, sf_dir)
    v, e, m = materialize(v), materialize(e), fx.markers(spark, sf_dir)
    states = materialize(mu.vertex_sequences(g.closure(e, v.where("kind = 'leaf'").select("v")), fx.haplotypes(spark, sf_dir), m))
    root = v.join(e.select(F.col("dst").alias("v")), "v", "left_anti").select("v")
    above = mu.long_sequences(states.join(root, "v", "left_semi")).where("derived").select("idx", F.col("v").alias("dst"))
    muts = mu.mutation_edges(mu.edge_differences(e, states, m)).select("idx", "dst").unionByName(above)
    records = spark.createDataFrame([(1, '{"parameters": {"rate": 1e-8, "population_size": 500}}'), (2, '{"parameters": {"rate": 2e-8, "sequence_length": 64}}')], "id int, record string")
    path = tb.write(tb.nodes(v), tb.edges(e, fx.MARKERS + 1.0), tb.sites(m), tb.mutations(muts), provenance_=records)
    told = tb.provenance(spark.read.parquet(f"{path}/provenance"))
    return tb.read_genotypes(spark, path).crossJoin(F.broadcast(told))


_FIRST = "f AS (SELECT * FROM ev WHERE ridx = 1)"


@query(f"WITH RECURSIVE {A}, {_FIRST} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, lo, CASE WHEN hi < 'infinity' THEN hi END AS hi FROM te WHERE dst NOT IN (SELECT unnest([a, b]) FROM f) UNION ALL SELECT rv, a, 0, NULL FROM f UNION ALL SELECT pa, rv, 0, bp FROM f UNION ALL SELECT cv, rv, bp, NULL FROM f UNION ALL SELECT cv, b, 0, NULL FROM f UNION ALL SELECT pb, cv, 0, NULL FROM f")
def recombine(spark, sf_dir):
    """The tree after its first event."""
    _, e, _ = fx.tree(spark, sf_dir)
    _, _, ev, _ = fx.graph(spark, sf_dir)
    f = ev.where("ridx = 1").first()
    out = g.recombine(e, (f.left_parent, f.a), (f.pb, f.b), f.rvertex, f.breakpoint)
    return out.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "lo", F.when(F.col("hi") < g.INF, F.col("hi")).alias("hi"))


@query(f"WITH RECURSIVE {A}, {_FIRST} SELECT CAST(ae.src AS BIGINT) AS src, CAST(ae.dst AS BIGINT) AS dst, CASE WHEN ae.dst = rv AND ae.src = cv THEN bp / 2 ELSE lo END AS lo, CASE WHEN ae.dst = rv AND ae.src <> cv THEN bp / 2 WHEN hi < 'infinity' THEN hi END AS hi FROM ae, f")
def gene_conversion(spark, sf_dir):
    """The graph after its first recombination's right parent takes all right of half the breakpoint."""
    _, e, ev, _ = fx.graph(spark, sf_dir)
    f = ev.where("ridx = 1").first()
    out = g.convert(e, (f.right_parent, f.rvertex), f.left_parent, f.breakpoint / 2)
    return out.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "lo", F.when(F.col("hi") < g.INF, F.col("hi")).alias("hi"))
