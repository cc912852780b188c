"""Queries over batches of structural events: what edges carry and which states stand below them, after all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import mutations as mu
from ..operators import structure as st
from ..operators.storage import materialize
from ..sources import fixtures as fx
from .genealogy_plans import SEQ_A, A, Case
from .registry import query
from .sequence_plans import HAP

#: From structural edges with masks, me (src, dst, mlo, mhi; an edge without a row carries nothing): places at which masks begin or end, the leaves that
#: each vertex reaches there, stretches of edges, and numbers of markers and derived markers of the vertex below.
_MADE = """gr AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, row_number() OVER (ORDER BY x) AS k FROM (SELECT 0::DOUBLE AS x UNION SELECT mlo FROM me UNION SELECT mhi FROM me WHERE mhi < 'infinity')),
mk AS (SELECT src, dst, x, k FROM me JOIN gr ON mlo <= x AND x < mhi),
rc AS (SELECT CAST(v AS BIGINT) AS anc, v AS leaf, x FROM lo, gr UNION SELECT mk.src, rc.leaf, rc.x FROM rc JOIN mk ON mk.dst = rc.anc AND mk.x = rc.x),
rx AS (SELECT DISTINCT anc, x FROM rc), ck AS (SELECT src, dst, mk.k, mk.k - row_number() OVER (PARTITION BY src, dst ORDER BY mk.k) AS isle FROM mk JOIN rx ON anc = dst AND rx.x = mk.x),
es AS (SELECT src, dst, min(x) AS lo, CASE WHEN bool_or(nx IS NULL) THEN NULL ELSE max(nx) END AS hi FROM ck JOIN gr USING (k) GROUP BY src, dst, isle),
sx AS (SELECT anc, idx, bool_and(derived) AS derived FROM rc JOIN gr ON gr.x = rc.x JOIN hap ON hap.v = leaf AND gr.x <= idx AND (nx IS NULL OR idx < nx) GROUP BY anc, idx),
nm AS (SELECT anc, count(*) AS n_markers, sum(derived::INT)::BIGINT AS n_derived FROM sx GROUP BY anc)
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, es.lo, es.hi, coalesce(n_markers, 0) AS n_markers, coalesce(n_derived, 0) AS n_derived FROM es LEFT JOIN nm ON anc = dst"""


def _told(out: st.Graph) -> DataFrame:
    """Stretches of edges with the numbers of markers and derived markers of the lower end."""
    count = lambda c: F.sum(F.bit_count(c)).cast("long")
    per = out.sequences.groupBy(F.col("v").alias("dst")).agg(count("mask").alias("n_markers"), count("bits").alias("n_derived"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = out.edges.where("lo < hi").join(per, "dst", "left")
    return rows.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "lo", F.when(F.col("hi") < g.INF, F.col("hi")).alias("hi"), zero("n_markers"), zero("n_derived"))


def _tree(spark, sf_dir) -> tuple[st.Graph, int]:
    """The tree of the haplotypes as a graph without recombinations."""
    v, e, n = fx.tree(spark, sf_dir)
    v, e = materialize(v, "vertices"), materialize(e.select("src", "dst", "lo", "hi"), "edges")
    closure = g.closure(e, v.where("kind = 'leaf'").select("v"))
    seqs = mu.vertex_sequences(closure, fx.haplotypes(spark, sf_dir), fx.markers(spark, sf_dir))
    return st.Graph(v, e, spark.createDataFrame([], "v int, src int, lo double, hi double"), materialize(seqs, "sequences")), n


def _graph(spark, sf_dir) -> tuple[st.Graph, DataFrame]:
    c = Case(spark, sf_dir)
    return st.Graph(c.vertices, c.edges, materialize(st.side_masks(c.events), "masks"), c.sequences), c.events


def _timed(spark, sf_dir, tree: st.Graph) -> DataFrame:
    """Events of the fixture with m, the lower of the latitudes that their edges hang from."""
    _, _, ev, _ = fx.graph(spark, sf_dir)
    lat = lambda c, name: tree.vertices.select(F.col("v").alias(c), F.col("latitude").alias(name))
    return ev.join(lat("left_parent", "la"), "left_parent").join(lat("pb", "lb"), "pb").withColumn("m", F.least("la", "lb"))


_FIRST = ("left_parent as rsrc", "a as rdst", "pb as csrc", "b as cdst", "breakpoint", "0.25D * m as rlat", "0.5D * m as clat")


@query(f"""{SEQ_A}, nm AS (SELECT v, count(*) AS n_markers, sum(derived::INT)::BIGINT AS n_derived FROM vs GROUP BY v)
SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, lo, CASE WHEN hi < 'infinity' THEN hi END AS hi, coalesce(n_markers, 0) AS n_markers, coalesce(n_derived, 0) AS n_derived FROM ae LEFT JOIN nm ON v = dst""")
def recombine_batch(spark, sf_dir):
    """The tree after all its events, replayed together."""
    tree, _ = _tree(spark, sf_dir)
    ev = _timed(spark, sf_dir, tree)
    return _told(st.recombine_all(tree, ev.selectExpr("ridx as event", *_FIRST), fx.markers(spark, sf_dir))[0])


_NESTED = f"""el AS (SELECT ridx, a, b, pa, pb, bp, m, n FROM em, n),
e2 AS (SELECT 2 * ridx - 1 AS k, pa AS rs, a AS rd, pb AS cs, b AS cd, bp, 0.25::DOUBLE * m AS rl, 0.5::DOUBLE * m AS cl FROM el
  UNION ALL SELECT 2 * ridx, pa, a, CASE WHEN ridx % 9 = 0 THEN NULL WHEN ridx % 3 = 1 THEN pb ELSE 2 * n - 1 + 2 * (2 * ridx - 1) END, CASE WHEN ridx % 9 = 0 THEN 2 * n - 1 WHEN ridx % 3 = 1 THEN b ELSE 2 * n - 1 + 2 * (2 * ridx - 1) - 1 END, 64 - bp, 0.1::DOUBLE * m,
    CASE WHEN ridx % 9 = 0 THEN (SELECT max(latitude) FROM tv) + ridx WHEN ridx % 3 = 1 THEN 0.75::DOUBLE * m ELSE 0.3::DOUBLE * m END FROM el),
e3 AS (SELECT e2.*, 2 * n - 1 + 2 * k - 1 AS rv, 2 * n - 1 + 2 * k AS cv FROM e2, n),
cu AS (SELECT rs AS s, rd AS d, rl AS lat, rv AS x FROM e3 UNION ALL SELECT cs, cd, cl, cv FROM e3),
ch AS (SELECT s, d, x, lag(x) OVER w AS under, lead(x) OVER w IS NULL AS high FROM cu WINDOW w AS (PARTITION BY s, d ORDER BY lat, x)),
oe AS (SELECT src AS s, dst AS d FROM te UNION ALL SELECT cv, rv FROM e3),
fe AS (SELECT s AS src, d AS dst, s, d FROM oe WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.s = oe.s AND cu.d = oe.d) UNION ALL SELECT x, coalesce(under, d), s, d FROM ch UNION ALL SELECT s, x, s, d FROM ch WHERE high AND s IS NOT NULL),
me AS (SELECT src, dst, CASE WHEN fe.s = e3.cv AND fe.d = e3.rv THEN bp ELSE 0 END::DOUBLE AS mlo, CASE WHEN e3.rv IS NULL OR (fe.s = e3.cv AND fe.d = e3.rv) THEN 'infinity'::DOUBLE ELSE bp END AS mhi FROM fe LEFT JOIN e3 ON e3.rv = dst)"""


@query(f"WITH RECURSIVE {A}, {HAP}, {_NESTED}, {_MADE}")
def recombine_nested(spark, sf_dir):
    """The tree after two events for each of its own: the second cuts the same edge further down and recoalesces with the second edge again, with the edge
    that the first made, or, every ninth, above the root."""
    tree, n = _tree(spark, sf_dir)
    ev = _timed(spark, sf_dir, tree)
    r, m = F.col("ridx"), F.col("m")
    link = 2 * n - 1 + 2 * (2 * r - 1)  # the first's recoalescence vertex
    top = tree.vertices.agg(F.max("latitude").alias("top"))
    case = lambda root, again, nested: F.when(r % 9 == 0, root).when(r % 3 == 1, again).otherwise(nested)
    two = ev.crossJoin(F.broadcast(top)).select((2 * r).alias("event"), F.col("left_parent").alias("rsrc"), F.col("a").alias("rdst"), case(F.lit(None), F.col("pb"), link).alias("csrc"), case(F.lit(2 * n - 1), F.col("b"), link - 1).alias("cdst"), (64 - F.col("breakpoint")).alias("breakpoint"), (0.1 * m).alias("rlat"), case(F.col("top") + r, 0.75 * m, 0.3 * m).alias("clat"))
    one = ev.selectExpr("2 * ridx - 1 as event", *_FIRST)
    return _told(st.recombine_all(tree, one.unionByName(two), fx.markers(spark, sf_dir))[0])


_CONVERTED = """me AS (SELECT src, dst, CASE WHEN dst = rv AND src = cv THEN CASE WHEN ridx % 3 = 1 THEN bp / 2 ELSE bp END ELSE 0 END AS mlo,
    CASE WHEN dst = rv AND src = cv AND ridx % 3 = 0 THEN (bp + 64) / 2 WHEN dst = rv AND src <> cv THEN CASE WHEN ridx % 3 = 1 THEN bp / 2 ELSE bp END ELSE 'infinity'::DOUBLE END AS mhi FROM ae LEFT JOIN ev ON rv = dst
  UNION ALL SELECT pa, rv, (bp + 64) / 2, 'infinity'::DOUBLE FROM ev WHERE ridx % 3 = 0)"""


@query(f"WITH RECURSIVE {A}, {HAP}, {_CONVERTED}, {_MADE}")
def gene_conversion_batch(spark, sf_dir):
    """The graph after conversions of two thirds of its recombinations: the right edge of every third takes what lies right of half the breakpoint, the left one of every other
    third takes what lies right of the middle of the rest, so that the right one is left with a tract."""
    whole, ev = _graph(spark, sf_dir)
    left = F.col("ridx") % 3 == 0
    pick = lambda a, b: F.when(left, F.col(a)).otherwise(F.col(b)).cast("int")
    told = ev.where("ridx % 3 <> 2").select(F.col("ridx").alias("event"), pick("left_parent", "right_parent").alias("src"), F.col("rvertex").cast("int").alias("dst"), pick("right_parent", "left_parent").alias("other"), F.when(left, (F.col("breakpoint") + fx.MARKERS) / 2).otherwise(F.col("breakpoint") / 2).alias("breakpoint"))
    return _told(st.convert_all(whole, told, fx.markers(spark, sf_dir))[0])
