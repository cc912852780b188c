"""Queries that walk over the recombination graph: conditional edge sets, stretches of places, masks, densities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import graph as g
from ..operators import mutations as mu
from ..operators import sample as sm
from ..operators import sampling as sp
from ..operators import sequences as sq
from ..operators import structure as st
from ..operators import tables as tb
from ..operators import traversal as tr
from ..operators.storage import materialize
from ..sources import fixtures as fx
from .genealogy_plans import POINTS, SEQ_A, UP_A, A, Case, T
from .registry import query
from .sequence_plans import HAP, IV, STR

#: Places and a marker that walks look at, a latitude that they stay above, the share of vertices whose ancestors are told.
LO, HI, IDX, LOW = 10.0, 30.0, 20, 5.0
K = """ak AS (SELECT ae.*, s.kind AS sk, d.kind AS dk, s.latitude AS sl, d.latitude AS dl FROM ae JOIN av s ON s.v = src JOIN av d ON d.v = dst)"""
_IN = "{0}lo < 30 AND {0}hi > 10"
_ENDS = "CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst"


def _down(ok: str, within: str, root: str = "2 * n - 1") -> str:
    """SQL of a walk downwards over the rows of ok."""
    return f"""td AS (SELECT src, dst FROM {ok} k, n WHERE src = {root} AND {within.format('k.')} UNION SELECT k.src, k.dst FROM td JOIN {ok} k ON k.src = td.dst WHERE ({within.format('k.')}) OR k.sk = 'rec')"""


def _up(ok: str, within: str, starts: str) -> str:
    return f"""tu AS (SELECT src, dst FROM {ok} k WHERE dst IN ({starts}) AND {within.format('k.')} UNION SELECT k.src, k.dst FROM tu JOIN {ok} k ON k.dst = tu.src WHERE ({within.format('k.')}) OR k.dk = 'coal')"""


def _long(df, *names):
    return df.select(*(F.col(c).cast("long").alias(c) for c in names))


def _walk(spark, sf_dir):
    c = Case(spark, sf_dir)
    return c, materialize(tr.with_kinds(c.edges, c.vertices))


# walks


@query(f"WITH RECURSIVE {A}, {K}, {_down('ak', _IN)} SELECT {_ENDS} FROM td")
def edges_topdown(spark, sf_dir):
    """Edges at [10, 30) from the highest vertex downwards."""
    c, e = _walk(spark, sf_dir)
    return _long(tr.edges_down(e, 2 * c.n - 1, g.meets(LO, HI)), "src", "dst")


@query(f"WITH RECURSIVE {A}, {K}, {_up('ak', _IN, 'SELECT v FROM lo WHERE v % 5 = 0')} SELECT {_ENDS} FROM tu")
def edges_bottomup(spark, sf_dir):
    """Edges at [10, 30) above every fifth leaf."""
    c, e = _walk(spark, sf_dir)
    return _long(tr.edges_up(e, c.vertices.where("kind = 'leaf' and v % 5 = 0").select("v"), g.meets(LO, HI)), "src", "dst")


@query(f"WITH RECURSIVE {A}, {K}, ok AS (SELECT * FROM ak WHERE sl >= 100), {_down('ok', _IN)} SELECT {_ENDS} FROM td")
def edges_interval_rooted(spark, sf_dir):
    """Edges at [10, 30) that are reached from the highest vertex without going below latitude 100."""
    c, e = _walk(spark, sf_dir)
    return _long(tr.edges_down(e, 2 * c.n - 1, g.meets(LO, HI), F.col("src_lat") >= 100), "src", "dst")


@query(f"""WITH RECURSIVE {A}, {K}, {IV}, pl AS (SELECT user_id, lo % 640 / 10 AS lo, lo % 640 / 10 + 0.5 + CASE WHEN event_id % 50 = 0 THEN 9.5 ELSE 0 END AS hi FROM iv),
ok AS (SELECT user_id, src, dst, len, false AS passing FROM (SELECT ak.*, sl - dl AS len FROM ak) k JOIN pl ON k.lo < pl.hi AND pl.lo < k.hi UNION SELECT user_id, src, dst, sl - dl, true FROM ak, (SELECT DISTINCT user_id FROM iv) WHERE sk = 'rec'),
td AS (SELECT user_id, src, dst, len FROM ok, n WHERE src = 2 * n - 1 AND NOT passing UNION SELECT ok.user_id, ok.src, ok.dst, ok.len FROM td JOIN ok ON ok.user_id = td.user_id AND ok.src = td.dst)
SELECT user_id, count(*) AS n_edges, round(sum(len), 4) AS length FROM td GROUP BY user_id""")
def edges_interval_each(spark, sf_dir):
    """Edges at each user's own set of stretches, from the highest vertex downwards, and their length; all users in one pass, those whose sets overlap
    the same stretches of edges as one."""
    c, e = _walk(spark, sf_dir)
    sets = fx.place_sets(spark, sf_dir)
    roots = sets.select("user_id", F.lit(2 * c.n - 1).alias("v")).distinct()
    length = e.select("src", "dst", (F.col("src_lat") - F.col("dst_lat")).alias("len")).distinct()
    walked, members = tr.walks_down(e, roots, sets, "user_id")
    sums = walked.join(length, ["src", "dst"]).groupBy("_walk").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("len"), 4).alias("length"))
    return members.join(sums, "_walk").select("user_id", "n_edges", "length")


_REC = f"""st AS (SELECT v, derived FROM vs WHERE idx = {IDX}), ok AS (SELECT ak.* FROM ak LEFT JOIN st ON st.v = dst LEFT JOIN ev ON ev.rv = dst
WHERE NOT (lo <= {IDX} AND hi > {IDX} AND NOT coalesce(derived, false)) AND sl >= {LOW} AND NOT (dk = 'rec' AND NOT CASE WHEN src = pa THEN {IDX} < bp ELSE bp <= {IDX} END))"""


@query(f"{SEQ_A}, {K}, {_REC}, {_down('ok', _IN)} SELECT {_ENDS} FROM td")
def edges_rec(spark, sf_dir):
    """Edges at [10, 30) on which a recombination at marker 20, derived there, may recoalesce above latitude 5."""
    c, e = _walk(spark, sf_dir)
    e = tr.with_sides(tr.with_states(e, c.sequences, IDX, IDX), c.events)
    return _long(tr.edges_down(e, 2 * c.n - 1, g.meets(LO, HI), tr.rec_candidates(float(IDX), LOW)), "src", "dst")


@query(f"{SEQ_A}, {K}, {_REC}, {_down('ok', _IN)}, w AS (SELECT td.src, td.dst, sl - greatest(dl, {LOW}) AS w FROM td JOIN ak USING (src, dst) WHERE sl > {LOW}) SELECT {_ENDS}, round(w, 6) AS w, round(ln(w) - ln((SELECT sum(w) FROM w)), 6) AS log_p FROM w")
def sample_cedge_window(spark, sf_dir):
    """Those edges with their chances, by their lengths above latitude 5."""
    c, e = _walk(spark, sf_dir)
    told = tr.with_sides(tr.with_states(e, c.sequences, IDX, IDX), c.events)
    some = tr.edges_down(told, 2 * c.n - 1, g.meets(LO, HI), tr.rec_candidates(float(IDX), LOW)).select("src", "dst")
    w = sp.edge_weights(some.join(e, ["src", "dst"]), LOW)
    return w.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("w", 6).alias("w"), F.round("log_p", 6).alias("log_p"))


_AT = f"{{0}}lo <= {IDX} AND {{0}}hi > {IDX}"
_COAL = f"""st AS (SELECT v, derived FROM vs WHERE idx = {IDX}), f AS (SELECT pa, rv FROM ev WHERE ridx = 1), ok AS (SELECT ak.* FROM ak LEFT JOIN st ON st.v = dst WHERE NOT coalesce(derived, false) AND sl >= {LOW} AND NOT EXISTS (SELECT 1 FROM f WHERE f.pa = src AND f.rv = dst))"""


def _coal(spark, sf_dir):
    c, e = _walk(spark, sf_dir)
    f = c.events.where("ridx = 1").first()
    ok = tr.coal_candidates(f.left_parent, f.rvertex, LOW)
    return e, tr.edges_down(tr.with_states(e, c.sequences, IDX, IDX), 2 * c.n - 1, g.covers(float(IDX)), ok)


@query(f"{SEQ_A}, {K}, {_COAL}, {_down('ok', _AT)} SELECT {_ENDS} FROM td")
def edges_coal(spark, sf_dir):
    """Edges at marker 20 on which the first event's left edge may recoalesce, wild there, above latitude 5."""
    return _long(_coal(spark, sf_dir)[1], "src", "dst")


@query(f"{SEQ_A}, {K}, {_COAL}, {_down('ok', _AT)}, w AS (SELECT td.src, td.dst FROM td JOIN ak USING (src, dst) WHERE dl <= 40 AND sl >= 40) SELECT {_ENDS}, round(-ln((SELECT count(*) FROM w)), 6) AS log_p FROM w")
def sample_cedge_wild(spark, sf_dir):
    """Those of them that span latitude 40, with their chances."""
    e, some = _coal(spark, sf_dir)
    w = tr.uniform_weights(some.select("src", "dst").join(e.select("src", "dst", "src_lat", "dst_lat"), ["src", "dst"]), 40.0)
    return w.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("log_p", 6).alias("log_p"))


@query(f"{SEQ_A}, {K}, st AS (SELECT v, bool_or(derived) AS derived FROM vs WHERE idx BETWEEN 17 AND 32 GROUP BY v), ok AS (SELECT ak.* FROM ak JOIN st ON st.v = dst WHERE derived), {_up('ok', '{0}lo < 33 AND {0}hi > 17', 'SELECT v FROM lo')} SELECT {_ENDS} FROM tu")
def edges_mmn(spark, sf_dir):
    """Edges at [17, 33) above leaves, as long as a marker from 17 to 32 is derived."""
    c, e = _walk(spark, sf_dir)
    e = tr.with_states(e, c.sequences, 17, 32)
    return _long(tr.edges_up(e, c.vertices.where("kind = 'leaf'").select("v"), g.meets(17.0, 33.0), F.col("derived")), "src", "dst")


# stretches of places


@query(f"""WITH RECURSIVE {A}, fe AS (SELECT DISTINCT src, dst FROM ae WHERE {_IN.format('')}), st AS (SELECT v AS set_id, unnest([v, v + 7]) AS leaf FROM lo, n WHERE v + 7 <= n AND v % 10 = 1),
rc AS (SELECT DISTINCT CAST(leaf AS BIGINT) AS anc, leaf FROM st UNION SELECT fe.src, rc.leaf FROM rc JOIN fe ON fe.dst = rc.anc), wh AS (SELECT set_id, anc FROM st JOIN rc USING (leaf) GROUP BY set_id, anc HAVING count(DISTINCT leaf) = 2),
dn AS (SELECT a.set_id, fe.src, min(fe.dst) AS t FROM fe JOIN wh a ON a.anc = fe.src JOIN wh b ON b.set_id = a.set_id AND b.anc = fe.dst GROUP BY a.set_id, fe.src),
wk AS (SELECT DISTINCT set_id, 2 * n - 1 AS v FROM st, n UNION SELECT wk.set_id, dn.t FROM wk JOIN dn ON dn.set_id = wk.set_id AND dn.src = wk.v)
SELECT CAST(wk.set_id AS BIGINT) AS set_id, CAST(wk.v AS BIGINT) AS mrca, round(latitude, 6) AS tmrca FROM wk JOIN av ON av.v = wk.v WHERE NOT EXISTS (SELECT 1 FROM dn WHERE dn.set_id = wk.set_id AND dn.src = wk.v)""")
def mrca_interval(spark, sf_dir):
    """Common ancestors and their times of leaves v and v + 7, for every tenth v, over [10, 30)."""
    c = Case(spark, sf_dir)
    ids = c.vertices.where(f"kind = 'leaf' and v % 10 = 1 and v + 7 <= {c.n}")
    sets = ids.select(F.col("v").alias("set_id"), F.explode(F.array("v", (F.col("v") + 7).cast("int"))).alias("v"))
    got = tr.lowest_common(c.edges.where(g.meets(LO, HI)), sets, 2 * c.n - 1)
    lat = c.vertices.select(F.col("v").alias("mrca"), "latitude")
    return got.join(lat, "mrca").select(F.col("set_id").cast("long").alias("set_id"), F.col("mrca").cast("long").alias("mrca"), F.round("latitude", 6).alias("tmrca"))


_MX = f"""x AS (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in POINTS)}]) AS x), xe AS (SELECT DISTINCT x, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM ae, x WHERE lo <= x AND x < hi), xc AS (SELECT x, src AS anc, dst AS v FROM xe UNION SELECT xc.x, xe.src, xc.v FROM xc JOIN xe ON xe.x = xc.x AND xe.dst = xc.anc)"""


def _marginal(spark, sf_dir):
    c = Case(spark, sf_dir)
    e = g.at_points(c.edges, POINTS).select("x", "src", "dst").distinct()
    return tr.ancestors_in(e, e.select("x", F.col("dst").alias("v")).distinct(), ["x"])


@query(f"WITH RECURSIVE {A}, {_MX} SELECT x, v, count(*) AS n, CAST(sum(anc) AS BIGINT) AS total FROM xc GROUP BY x, v")
def ancestors_marginal(spark, sf_dir):
    """Ancestors of every vertex in three marginal trees."""
    return _marginal(spark, sf_dir).groupBy("x", F.col("v").cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum("anc").alias("total"))


@query(f"WITH RECURSIVE {A}, {_MX} SELECT x, anc AS v, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM xc GROUP BY x, anc")
def descendants_marginal_vertices(spark, sf_dir):
    """Descendants of every vertex, leaves or not, in three marginal trees."""
    return _marginal(spark, sf_dir).groupBy("x", F.col("anc").cast("long").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).withColumnRenamed("a", "v")


@query(f"WITH RECURSIVE {A} SELECT CAST(dst AS BIGINT) AS v, CAST(src AS BIGINT) AS dad FROM ae WHERE {_IN.format('')}")
def dads_interval(spark, sf_dir):
    """Parents by edges that overlap [10, 30)."""
    return Case(spark, sf_dir).edges.where(g.meets(LO, HI)).select(F.col("dst").cast("long").alias("v"), F.col("src").cast("long").alias("dad"))


@query(f"WITH RECURSIVE {A}, {_MX} SELECT x, CAST(src AS BIGINT) AS v, CAST(dst AS BIGINT) AS child FROM ae, x WHERE lo <= x AND x < hi")
def children_points(spark, sf_dir):
    return g.at_points(Case(spark, sf_dir).edges, POINTS).select("x", F.col("src").cast("long").alias("v"), F.col("dst").cast("long").alias("child"))


# masks, states


_BITS = "string_agg(CASE WHEN {0} THEN '1' ELSE '0' END, '' ORDER BY m.idx) AS bits"


@query(f"WITH RECURSIVE {A}, m AS (SELECT unnest(range(1, 65)) AS idx) SELECT {_ENDS}, {_BITS.format('lo <= idx AND idx < hi')} FROM ae, m GROUP BY src, dst")
def mask_edge(spark, sf_dir):
    """Markers that each edge is ancestral at."""
    e = Case(spark, sf_dir).edges.withColumn("k", F.struct("src", "dst"))
    out = sm.interval_masks(e.select("k", "lo", "hi"), fx.markers(spark, sf_dir), "k")
    return out.select(F.col("k.src").cast("long").alias("src"), F.col("k.dst").cast("long").alias("dst"), bits.to_string(F.col("mask"), F.col("n")).alias("bits"))


def _vertex_masks(c):
    return sm.interval_masks(g.vertex_intervals(c.edges, c.vertices), fx.markers(c.spark, c.sf_dir), "v")


@query(f"WITH RECURSIVE {A}, m AS (SELECT unnest(range(1, 65)) AS idx) SELECT CAST(v AS BIGINT) AS v, {_BITS.format('on_')} FROM (SELECT v, idx, kind = 'leaf' OR coalesce(bool_or(lo <= idx AND idx < hi), false) AS on_ FROM av CROSS JOIN m LEFT JOIN ae ON ae.src = v GROUP BY v, kind, idx) m GROUP BY v")
def mask_vertex(spark, sf_dir):
    """Markers that each vertex is ancestral at."""
    return _vertex_masks(Case(spark, sf_dir)).select(F.col("v").cast("long").alias("v"), bits.to_string(F.col("mask"), F.col("n")).alias("bits"))


@query(f"{SEQ_A} SELECT CAST(x.v AS BIGINT) AS v1, CAST(x.v + 1 AS BIGINT) AS v2, bool_and(x.derived = y.derived) AS equal FROM vs x JOIN vs y ON y.v = x.v + 1 AND y.idx = x.idx GROUP BY x.v")
def vertex_eq(spark, sf_dir):
    """Whether each vertex has the states of the next, at the markers of both."""
    c = Case(spark, sf_dir)
    pairs = c.vertices.select(F.col("v").alias("v1"), (F.col("v") + 1).cast("int").alias("v2"))
    return mu.equal_under_masks(pairs, c.sequences, materialize(_vertex_masks(c))).select(F.col("v1").cast("long").alias("v1"), F.col("v2").cast("long").alias("v2"), "equal")


@query(f"WITH {HAP} SELECT a.v, CAST(sum(CASE WHEN a.derived <> b.derived AND a.idx BETWEEN 5 AND 40 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM hap a JOIN hap b ON b.v = a.v + 1 AND b.idx = a.idx GROUP BY a.v")
def nmutations_pair(spark, sf_dir):
    """Markers from 5 to 40 at which a haplotype differs from the next."""
    mask = bits.mask_range(F.col("n"), F.lit(5), F.lit(40))
    return sq.neighbours(fx.haplotypes(spark, sf_dir)).select("v", mu.pair_mutations(F.col("a"), F.col("b"), mask).alias("n"))


@query(f"{SEQ_A}, s AS (SELECT v, derived FROM vs WHERE idx = 33) SELECT {_ENDS}, coalesce(x.derived, false) <> coalesce(y.derived, false) AS is_mutation FROM ae LEFT JOIN s x ON x.v = src LEFT JOIN s y ON y.v = dst")
def ismutation_edge(spark, sf_dir):
    """Whether the ends of each edge differ at marker 33."""
    c = Case(spark, sf_dir)
    return mu.differs_at(c.edges, c.sequences, 33).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "is_mutation")


@query(f"{SEQ_A}, m AS (SELECT unnest(range(1, 65)) AS idx), s AS (SELECT av.v, {_BITS.format('coalesce(derived, false)')} FROM av CROSS JOIN m LEFT JOIN vs ON vs.v = av.v AND vs.idx = m.idx GROUP BY av.v) SELECT {_ENDS}, x.bits AS above, y.bits AS below FROM ae JOIN s x ON x.v = src JOIN s y ON y.v = dst")
def edge_sequences(spark, sf_dir):
    """The pair of sequences at the ends of each edge."""
    c = Case(spark, sf_dir)
    n = fx.markers(spark, sf_dir).agg(F.max("idx").alias("n"))
    whole = c.sequences.groupBy("v").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "bits"))), lambda x: x.bits).alias("chunks")).crossJoin(F.broadcast(n))
    s = whole.select("v", bits.to_string(F.col("chunks"), F.col("n")).alias("s"))
    return c.edges.select("src", "dst").join(s.select(F.col("v").alias("src"), F.col("s").alias("above")), "src").join(s.select(F.col("v").alias("dst"), F.col("s").alias("below")), "dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "above", "below")


@query(f"WITH RECURSIVE {A}, q AS (SELECT DISTINCT l_partkey AS v FROM lineitem) SELECT q.v, av.v IS NOT NULL AS has_vertex FROM q LEFT JOIN av ON av.v = q.v")
def has_vertex(spark, sf_dir):
    v = Case(spark, sf_dir).vertices.select(F.col("v").cast("long").alias("v"), F.lit(True).alias("there"))
    q = fx.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v")).distinct()
    return q.join(v, "v", "left").select("v", F.coalesce("there", F.lit(False)).alias("has_vertex"))


# constructors and shows


@query("SELECT CAST(vec_id + 1 AS BIGINT) AS v, 0::DOUBLE AS latitude, CAST(0 AS BIGINT) AS n_edges FROM embeddings UNION ALL SELECT g, 0, 0 FROM (SELECT unnest(range(count(*) + 1, 2 * count(*))) AS g FROM embeddings)")
def tree_from_sample(spark, sf_dir):
    """A tree not yet built: leaves of the sample and room for inner vertices, without edges."""
    vertices, edges = tb.unbuilt_tree(fx.haplotypes(spark, sf_dir))
    n = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n_edges"))
    return vertices.join(n, "v", "left").select(F.col("v").cast("long").alias("v"), "latitude", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query(f"WITH RECURSIVE {T} SELECT {_ENDS}, lo, hi IS NULL OR hi = 'infinity' AS endless, CAST(0 AS BIGINT) AS n_recombinations FROM te")
def arg_from_tree(spark, sf_dir):
    """The tree as a graph: all edges carry all places, no recombination."""
    v, e, _ = fx.tree(spark, sf_dir)
    rec = v.where("kind = 'rec'").agg(F.count(F.lit(1)).alias("n_recombinations"))
    return g.arg_from_tree(e.select("src", "dst")).crossJoin(F.broadcast(rec)).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "lo", (F.col("hi") == g.INF).alias("endless"), "n_recombinations")


@query(f"WITH {STR}, m AS (SELECT max(length(bits)) AS n FROM s) SELECT 'sample' AS what, (SELECT count(*) FROM s) AS sequences, CAST(n AS BIGINT) AS markers, CAST(n AS DOUBLE) AS sequence_length, round((SELECT sum(length(replace(bits, '0', ''))) FROM s) / ((SELECT count(*) FROM s) * n), 6) AS share_derived FROM m")
def show_sample(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    end = fx.markers(spark, sf_dir).agg(F.max("position").alias("sequence_length"), F.count(F.lit(1)).alias("markers"))
    per = h.agg(F.count(F.lit(1)).alias("sequences"), F.sum(bits.popcount(F.col("chunks"))).alias("d"))
    return per.crossJoin(end).select(F.lit("sample").alias("what"), "sequences", "markers", "sequence_length", F.round(F.col("d") / (F.col("sequences") * F.col("markers")), 6).alias("share_derived"))


@query(f"WITH {STR} SELECT v, CAST(length(bits) AS VARCHAR) || '-marker sequence: ' || substr(bits, 1, 20) || '...' || right(bits, 20) AS shown FROM s")
def show_sequence(spark, sf_dir):
    """The first and last markers of each long sequence."""
    h = fx.haplotypes(spark, sf_dir).select("v", "n", bits.to_string(F.col("chunks"), F.col("n")).alias("bits"))
    return h.select("v", F.concat(F.col("n"), F.lit("-marker sequence: "), F.substring("bits", 1, 20), F.lit("..."), F.expr("right(bits, 20)")).alias("shown"))


@query(f"{SEQ_A}, {K} SELECT {_ENDS}, {_IN.format('')} AS visible FROM ak")
def plot_edges(spark, sf_dir):
    """Edges as a plot of [10, 30) draws them: those elsewhere are hidden."""
    return Case(spark, sf_dir).edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), g.meets(LO, HI).alias("visible"))


@query(f"WITH RECURSIVE {A}, t AS (SELECT ae.*, latitude FROM ae JOIN av ON v = src) SELECT CAST(row_number() OVER (ORDER BY latitude, src, dst, lo) - 1 AS BIGINT) AS id, lo AS \"left\", CAST(src - 1 AS BIGINT) AS parent, CAST(dst - 1 AS BIGINT) AS child FROM t")
def ts(spark, sf_dir):
    """Edges in the order that tree-sequence tables ask for, numbered."""
    c = Case(spark, sf_dir)
    return tb.ordered_edges(tb.nodes(c.vertices), tb.edges(c.edges, float(fx.MARKERS))).select("id", "left", F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child"))


@query(f"""WITH RECURSIVE {A}, t AS (SELECT src - 1 AS parent, dst - 1 AS child, lo AS l, least(hi, {float(fx.MARKERS)}) AS r, latitude AS t FROM ae JOIN av ON v = src)
SELECT CAST(row_number() OVER (ORDER BY t, parent, child, l) - 1 AS BIGINT) AS id, l AS "left", r AS "right", CAST(parent AS BIGINT) AS parent, CAST(child AS BIGINT) AS child,
CAST(row_number() OVER (ORDER BY l, t, parent, child) - 1 AS BIGINT) AS insertion, CAST(row_number() OVER (ORDER BY r, t DESC, parent DESC, child DESC, l DESC) - 1 AS BIGINT) AS removal FROM t""")
def ts_index(spark, sf_dir):
    """Edges of the tree-sequence tables with the orders in which they enter and leave the tree."""
    c = Case(spark, sf_dir)
    return tb.indexed_edges(tb.nodes(c.vertices), tb.edges(c.edges, float(fx.MARKERS))).select("id", "left", "right", *(F.col(x).cast("long").alias(x) for x in ("parent", "child", "insertion", "removal")))


#: Thresholds of the wide haplotypes' markers.
_WIDE = ", ".join(f"{t}::DOUBLE" for t in fx.THRESHOLDS)


@query(f"""{UP_A}, wh AS (SELECT CAST(vec_id + 1 AS INTEGER) AS v, CAST({len(fx.THRESHOLDS)} * (j - 1) + k AS INTEGER) AS idx, embedding[j] > [{_WIDE}][k] AS derived FROM embeddings, range(1, 65) a(j), range(1, {len(fx.THRESHOLDS) + 1}) b(k) WHERE j <= len(embedding)),
ws AS (SELECT anc AS v, idx, bool_and(derived) AS derived FROM cl JOIN wh ON wh.v = cl.v AND lo <= idx / {float(len(fx.THRESHOLDS))} AND idx / {float(len(fx.THRESHOLDS))} < hi GROUP BY anc, idx),
k AS (SELECT DISTINCT s.idx, ae.src, ae.dst FROM ae JOIN ws s ON s.v = ae.src JOIN ws d ON d.v = ae.dst AND d.idx = s.idx WHERE lo <= s.idx / {float(len(fx.THRESHOLDS))} AND s.idx / {float(len(fx.THRESHOLDS))} < hi AND s.derived <> d.derived AND ae.src NOT IN (SELECT rv FROM ev)),
f AS (SELECT idx FROM k GROUP BY idx HAVING count(*) > 1), st AS (SELECT DISTINCT CAST(o_orderkey % 32 * 10 + 1 AS INTEGER) AS start FROM orders), g AS (SELECT start, min(idx) AS idx FROM st JOIN f ON idx >= start GROUP BY start)
SELECT start, k.idx, CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM g JOIN k ON k.idx = g.idx""")
def next_inconsistent_from(spark, sf_dir):
    """The next marker with several mutations from each of the starts that order keys give, over haplotypes of five chunks."""
    c = Case(spark, sf_dir)
    m = fx.wide_markers(spark, sf_dir)
    sequences = materialize(mu.vertex_sequences(c.closure, fx.wide_haplotypes(spark, sf_dir), m), "sequences")
    starts = fx.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 32 * 10 + 1).cast("int").alias("start"))
    return mu.next_inconsistent_from(c.edges, sequences, m, c.events, starts).select("start", "idx", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


# densities, descents, bounds


@query("WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT o_custkey AS custkey, round(sum(ln(o_totalprice / s)), 6) AS log_density, round(exp(sum(ln(o_totalprice / s))), 9) AS density FROM orders JOIN t USING (o_custkey) GROUP BY 1")
def dens(spark, sf_dir):
    """Density of each customer's draws, all orders by their prices, from the log chance of each."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.ln("o_totalprice").alias("x"))
    parts = o.join(sp.log_sum_exp(o, ["custkey"], "x"), "custkey").select("custkey", (F.col("x") - F.col("lse")).alias("log_p"))
    both = sp.density(parts, ["custkey"], "log_p", logscale=True).withColumnRenamed("density", "log_density").join(sp.density(parts, ["custkey"], "log_p"), "custkey")
    return both.select("custkey", F.round("log_density", 6).alias("log_density"), F.round("density", 9).alias("density"))


@query("SELECT o_custkey AS custkey, round(ln(sum(o_totalprice)), 6) AS log_density FROM orders GROUP BY 1")
def add_logdensity(spark, sf_dir):
    """Log densities after one more step: that of a customer's dearest order alone, plus what is left to the log of all."""
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.ln("o_totalprice").alias("x"))
    first = o.groupBy("custkey").agg(F.max("x").alias("log_p"))
    more = first.join(sp.log_sum_exp(o, ["custkey"], "x"), "custkey").select("custkey", (F.col("lse") - F.col("log_p")).alias("log_p"))
    return sp.density(first.unionByName(more), ["custkey"], "log_p", logscale=True).select("custkey", F.round("density", 6).alias("log_density"))


_ME = "me AS (SELECT DISTINCT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM ae WHERE lo <= 33 AND 33 < hi)"


@query(f"""{SEQ_A}, {_ME}, s AS (SELECT v, derived FROM vs WHERE idx = 33), oc AS (SELECT src, min(dst) AS c FROM me GROUP BY src HAVING count(*) = 1), ok AS (SELECT oc.src, c FROM oc JOIN s x ON x.v = oc.src JOIN s y ON y.v = c WHERE x.derived = y.derived),
w AS (SELECT src, dst, dst AS d FROM me UNION SELECT w.src, w.dst, ok.c FROM w JOIN ok ON ok.src = w.d) SELECT w.src, w.dst, round(latitude, 6) AS rlat FROM w JOIN av ON av.v = d WHERE d NOT IN (SELECT src FROM ok)""")
def rlat_min(spark, sf_dir):
    """Lowest latitude of a recombination on each edge at marker 33."""
    c = Case(spark, sf_dir)
    e = materialize(c.edges.where(g.covers(33.0)).select("src", "dst").distinct())
    state = mu.long_sequences(c.sequences).where("idx = 33").select("v", "derived")
    out = tr.lowest_start(e, state, c.vertices)
    return out.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("rlat", 6).alias("rlat"))


@query(f"""WITH RECURSIVE {A}, {_ME}, fc AS (SELECT src, min(dst) AS c FROM me GROUP BY src), q AS (SELECT row_number() OVER (ORDER BY src, dst) AS id, src, dst, d.latitude * 0.4 AS lat FROM me JOIN av d ON d.v = dst),
w AS (SELECT id, src, dst, lat FROM q UNION ALL SELECT w.id, w.dst, fc.c, lat FROM w JOIN av d ON d.v = w.dst JOIN fc ON fc.src = w.dst WHERE lat < d.latitude) SELECT q.src AS src0, q.dst AS dst0, w.src, w.dst FROM w JOIN q USING (id) JOIN av d ON d.v = w.dst WHERE d.latitude <= w.lat""")
def find_actual_edge(spark, sf_dir):
    """Below each edge at marker 33, by first children, the edge that spans two fifths of its lower end's latitude."""
    c = Case(spark, sf_dir)
    e = materialize(c.edges.where(g.covers(33.0)).select("src", "dst").distinct())
    lat = c.vertices.select(F.col("v").alias("dst"), "latitude")
    asked = e.join(lat, "dst").select(F.struct("src", "dst").alias("id"), "src", "dst", (F.col("latitude") * 0.4).alias("at"))
    out = tr.edge_at(e, asked, c.vertices)
    return out.select(*(F.col(x).cast("long").alias(y) for x, y in (("id.src", "src0"), ("id.dst", "dst0"), ("src", "src"), ("dst", "dst"))))


@query(f"""{SEQ_A}, p AS (SELECT ridx AS pair, b, rv, bp, 64 - ridx % 7 AS r FROM ev), m AS (SELECT unnest(range(1, 65)) AS idx),
s AS (SELECT pair, r, m.idx, NOT (bp <= m.idx) OR coalesce(x.derived, false) <> coalesce(y.derived, false) AS stop FROM p CROSS JOIN m LEFT JOIN vs x ON x.v = b AND x.idx = m.idx LEFT JOIN vs y ON y.v = rv AND y.idx = m.idx)
SELECT CAST(pair AS BIGINT) AS pair, CAST(r AS INTEGER) AS right_idx, CAST(coalesce(max(CASE WHEN stop AND idx < r THEN idx END), 0) AS INTEGER) AS left_idx FROM s GROUP BY pair, r""")
def breakpoint_bounds_ancestral(spark, sf_dir):
    """Bounds for the second leaf of each event against its right parental edge, which is ancestral right of the breakpoint alone."""
    c = Case(spark, sf_dir)
    p = c.events.select(F.col("ridx").alias("pair"), F.col("b").alias("rdst"), F.col("rvertex").cast("int").alias("cdst"), F.col("breakpoint").alias("lo"), F.lit(g.INF).alias("hi"), (64 - F.col("ridx") % 7).cast("int").alias("right_idx"))
    stops = mu.bound_stops(p, c.sequences, fx.markers(spark, sf_dir))
    return mu.breakpoint_bounds(p.select("pair", "right_idx"), stops).select(F.col("pair").cast("long").alias("pair"), "right_idx", "left_idx")


_U = "(o_orderkey * 7919 % 10007 + 0.5::DOUBLE) / 10007"


@query(f"""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice / 1e5 AS x, -ln(-ln({_U})) AS gm, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), k AS (SELECT * FROM o WHERE place = 1 OR place <= floor(n * 0.5)),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY x + gm DESC) AS j, ln(sum(exp(x)) OVER (PARTITION BY o_custkey)) AS lse FROM k) SELECT o_custkey AS custkey, o_orderkey AS orderkey, round(x - lse, 6) AS log_p FROM r WHERE j = 1""")
def gumbel_max_threshold(spark, sf_dir):
    """One of the first half of each customer's orders, drawn by price with numbers that order keys give."""
    u = (F.col("o_orderkey") * 7919 % 10007 + 0.5) / 10007
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), (F.col("o_totalprice") / 1e5).alias("x"), u.alias("u"))
    return sp.gumbel_max(o, ["custkey"], "orderkey", "x", u=F.col("u"), threshold=0.5).select("custkey", "orderkey", F.round("log_p", 6).alias("log_p"))


_CONVERTED = """f AS (SELECT * FROM ev WHERE ridx = 1), ce AS (SELECT ae.src, ae.dst, CASE WHEN ae.dst = rv AND ae.src = cv THEN bp / 2 ELSE lo END AS lo, CASE WHEN ae.dst = rv AND ae.src <> cv THEN bp / 2 ELSE hi END AS hi FROM ae, f)"""


@query(f"""WITH RECURSIVE {A}, {HAP}, {_CONVERTED}, cl AS (SELECT CAST(v AS BIGINT) AS anc, CAST(v AS BIGINT) AS v, CAST(0 AS DOUBLE) AS lo, CAST('infinity' AS DOUBLE) AS hi FROM lo
  UNION ALL SELECT ce.src, cl.v, greatest(cl.lo, ce.lo), least(cl.hi, ce.hi) FROM cl JOIN ce ON ce.dst = cl.anc WHERE greatest(cl.lo, ce.lo) < least(cl.hi, ce.hi))
SELECT anc AS v, idx, bool_and(derived) AS derived FROM cl JOIN hap ON hap.v = cl.v AND lo <= idx AND idx < hi GROUP BY anc, idx""")
def update_upstream(spark, sf_dir):
    """Sequences after the gene conversion of the first recombination; what changes is followed upstream and no further."""
    c = Case(spark, sf_dir)
    whole = st.Graph(c.vertices, c.edges, materialize(st.side_masks(c.events), "masks"), c.sequences)
    one = c.events.where("ridx = 1").select(F.col("ridx").alias("event"), F.col("right_parent").cast("int").alias("src"), F.col("rvertex").cast("int").alias("dst"), F.col("left_parent").cast("int").alias("other"), (F.col("breakpoint") / 2).alias("breakpoint"))
    out, _ = st.convert_all(whole, one, fx.markers(spark, sf_dir))
    return mu.long_sequences(out.sequences).select(F.col("v").cast("long").alias("v"), "idx", "derived")
