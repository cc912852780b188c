"""Genealogies as edge tables: navigation, closure, marginal trees, lengths and lineages.

edges: (src, dst, lo, hi), src the parent; vertices: (v, kind, latitude). Leaves are 1 .. n, coalescences
n + 1 .. 2n - 1, then even numbers are recombinations and odd ones recoalescences.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import simplify
from .storage import followed, materialize, ranked, running

INF = float("inf")
#: Levels that one job of a closure goes up.
LEVELS = 4


def covers(point) -> Column:
    return (F.col("lo") <= point) & (F.col("hi") > point)


def meets(lo: float, hi: float) -> Column:
    return (F.col("lo") < hi) & (F.col("hi") > lo)


def at_points(df: DataFrame, points: Sequence[float], name: str = "x") -> DataFrame:
    """df (lo, hi, ..) once for each of some given points that it covers, without a join."""
    every = F.array(*(F.lit(float(x)) for x in points))
    return df.withColumn(name, F.explode(F.filter(every, lambda x: (F.col("lo") <= x) & (F.col("hi") > x))))


def arg_from_tree(edges: DataFrame) -> DataFrame:
    """(src, dst, lo, hi) of a tree's edges: all of them carry all places."""
    return edges.select("src", "dst", F.lit(0.0).alias("lo"), F.lit(INF).alias("hi"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(anc, v, lo, hi, lvl): from each start v upwards along edges whose intervals intersect; v itself at
    level 0. Semi-naive: only the newest level is joined, LEVELS levels a job, each job's rows in a table."""
    up = materialize(edges.select(F.col("dst").alias("_d"), F.col("src").alias("_s"), F.col("lo").alias("_l"), F.col("hi").alias("_h")))
    level = starts.select(F.col("v").alias("anc"), "v", F.lit(0.0).alias("lo"), F.lit(INF).alias("hi"), F.lit(0).alias("lvl"))
    out = [level]
    at = 0
    while True:
        batch = None
        for _ in range(LEVELS):
            at += 1
            level = level.join(up, F.col("anc") == F.col("_d")).select(F.col("_s").alias("anc"), "v", F.greatest("lo", "_l").alias("lo"), F.least("hi", "_h").alias("hi"), F.lit(at).alias("lvl")).where("lo < hi")
            batch = level if batch is None else batch.unionByName(level)
        table = materialize(batch)
        if table.isEmpty():
            break
        out.append(table)
        level = table.where(F.col("lvl") == at)
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, kind, n_children, n_dads): an edge counts once, however many intervals it has."""
    one = edges.select("src", "dst").distinct()
    ends = one.select(F.col("src").alias("v"), F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(one.select(F.col("dst").alias("v"), F.lit(0).alias("c"), F.lit(1).alias("d")))
    per = ends.groupBy("v").agg(F.sum("c").alias("n_children"), F.sum("d").alias("n_dads"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int").alias(c)
    return vertices.select("v", "kind").join(per, "v", "left").select("v", "kind", zero("n_children"), zero("n_dads"))


def siblings(edges: DataFrame) -> DataFrame:
    """(v, dad, sibling): other children of each dad; not deduplicated across dads."""
    a, b = edges.select(F.col("src").alias("dad"), F.col("dst").alias("v")), edges.select(F.col("src").alias("dad"), F.col("dst").alias("sibling"))
    return a.join(b, "dad").where("v <> sibling").select("v", "dad", "sibling")


def other_dad(edges: DataFrame) -> DataFrame:
    """(src, dst, other): the other parent of a vertex with two, else src."""
    o = edges.select(F.col("src").alias("_o"), "dst")
    met = edges.select("src", "dst").join(o, "dst").groupBy("src", "dst").agg(F.min(F.when(F.col("_o") != F.col("src"), F.col("_o"))).alias("other"))
    return met.select("src", "dst", F.coalesce("other", "src").alias("other"))


def skip_unary(edges: DataFrame, towards: str = "children") -> DataFrame:
    """(v, to): neighbours of each vertex after following vertices with exactly one neighbour onwards, by pointer doubling."""
    near, far = ("src", "dst") if towards == "children" else ("dst", "src")
    e = edges.select(F.col(near).alias("v"), F.col(far).alias("to")).distinct()
    single = e.groupBy("v").agg(F.count(F.lit(1)).alias("_n"), F.min("to").alias("to")).where("_n = 1").drop("_n")
    ends = followed(single, [], "v", "to").select(F.col("v").alias("to"), F.col("to").alias("_end"))
    return e.join(ends, "to", "left").select("v", F.coalesce("_end", "to").alias("to")).distinct()


def vertex_intervals(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, lo, hi): union of each vertex's child edges' intervals, simplified; [0, inf) for a leaf."""
    inner = simplify(edges.select(F.col("src").alias("v"), "lo", "hi"), ["v"])
    return inner.unionByName(vertices.where("kind = 'leaf'").select("v", F.lit(0.0).alias("lo"), F.lit(INF).alias("hi")))


def with_latitudes(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges with src_lat and dst_lat."""
    s = vertices.select(F.col("v").alias("src"), F.col("latitude").alias("src_lat"))
    d = vertices.select(F.col("v").alias("dst"), F.col("latitude").alias("dst_lat"))
    return edges.join(s, "src").join(d, "dst")


def live_lineages(edges: DataFrame, vertices: DataFrame, latitudes: DataFrame) -> DataFrame:
    """(latitude, n): edges alive at each latitude (ends included), one more above the highest vertex.

    Counting by sorted ends instead of pairs: births at or below minus deaths below. What happens at one latitude is combined first, map-side, so that the many
    leaves at 0 are one row; latitudes are then numbered by ranges and summed in blocks of numbers, so no part has more than its share.
    """
    e = with_latitudes(edges, vertices)
    zero = F.lit(0).cast("long")
    row = lambda df, at, born, gone, asked: df.select(F.col(at).alias("at"), born.alias("born"), gone.alias("gone"), F.lit(asked).alias("asked"))
    one = F.lit(1).cast("long")
    ends = row(e, "dst_lat", one, zero, False).unionByName(row(e, "src_lat", zero, one, False)).unionByName(row(latitudes, "latitude", zero, zero, True))
    per = ends.groupBy("at").agg(F.sum("born").alias("born"), F.sum("gone").alias("gone"), F.bool_or("asked").alias("asked"))
    placed = materialize(ranked(per.withColumn("net", F.col("born") - F.col("gone")), ["at"], "place"), "latitudes")
    top = vertices.agg(F.max("latitude").alias("top"))
    told = running(placed, "place", "net", "run").where("asked").crossJoin(F.broadcast(top))  # one row
    above = F.when(F.col("at") > F.greatest("top", F.lit(1e-9)), 1).otherwise(0)
    return told.select(F.col("at").alias("latitude"), (F.col("run") + F.col("gone") + above).cast("int").alias("n"))


def root_times(closure_: DataFrame, n: int, at: DataFrame, vertices: DataFrame) -> DataFrame:
    """(x, tmrca): latitude of the lowest vertex above all n leaves in the tree at each x of a table.

    A sweep for each vertex: leaves are gained at lo and lost at hi, so the places at which it has all of them are where a
    running count is n. Vertices that never gain as many are left out; the turns of the others are numbered over ranges and counted in blocks of
    numbers, so the root, which turns at every breakpoint, is spread over tasks. Only the few stretches with all leaves are spread over the
    points between their ends.
    """
    strict = closure_.where("lvl > 0")
    one, none = F.lit(1), F.lit(0)
    gain = strict.select("anc", F.col("lo").alias("x"), one.alias("d"), one.alias("g")).unionByName(strict.where(F.col("hi") < INF).select("anc", F.col("hi").alias("x"), (-one).alias("d"), none.alias("g")))
    per = materialize(gain.groupBy("anc", "x").agg(F.sum("d").alias("d"), F.sum("g").alias("g")), "turns")
    enough = per.groupBy("anc").agg(F.sum("g").alias("g")).where(F.col("g") >= n).select("anc")
    placed = materialize(ranked(per.join(enough, "anc", "left_semi").select("anc", "x", "d"), ["anc", "x"], "place"), "turns")
    counted = materialize(running(placed, "place", "d", "run"), "turns")
    begin = counted.groupBy("anc").agg(F.min_by(F.col("run") - F.col("d"), "place").alias("begin"))
    onward = counted.select("anc", F.col("x").alias("hi"), (F.col("place") - 1).alias("place"))
    turns = counted.join(begin, "anc").where(F.col("run") - F.col("begin") >= n).join(onward, ["anc", "place"], "left").select("anc", F.col("x").alias("lo"), "hi")
    full = materialize(turns.join(vertices.select(F.col("v").alias("anc"), "latitude"), "anc").select("lo", "hi", "latitude").distinct())
    places = at.select("x", F.lit(True).alias("asked")).unionByName(full.select(F.col("lo").alias("x"), F.lit(False).alias("asked"))).unionByName(full.where("hi is not null").select(F.col("hi").alias("x"), F.lit(False).alias("asked")))
    places = materialize(ranked(places.groupBy("x").agg(F.bool_or("asked").alias("asked")), ["x"], "place"))
    low, high = places.select(F.col("x").alias("lo"), F.col("place").alias("a")), places.select(F.col("x").alias("hi"), F.col("place").alias("b"))
    end = places.agg((F.max("place") + 1).alias("end"))
    spans = full.join(low, "lo").join(high, "hi", "left").crossJoin(F.broadcast(end))
    met = spans.select("latitude", F.explode(F.sequence("a", F.coalesce("b", "end") - 1)).alias("place"))
    return met.join(places.where("asked").select("place", "x"), "place").groupBy("x").agg(F.min("latitude").alias("tmrca"))


def event_rules(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, side_lo, side_hi): the side of the breakpoint that each edge above a recombination carries."""
    e = edges.select("src", "dst").join(events, F.col("dst") == F.col("rvertex"))
    left = F.col("src") == F.col("left_parent")
    return e.select("src", "dst", F.when(left, 0.0).otherwise(F.col("breakpoint")).alias("side_lo"), F.when(left, F.col("breakpoint")).alias("side_hi"))


def recombine(edges: DataFrame, redge: tuple[int, int], cedge: tuple[int, int], rvertex: int, breakpoint: float) -> DataFrame:
    """Edges after one recombination on redge that recoalesces on cedge: rvertex and rvertex + 1 are new.

    redge (s, d) becomes rvertex -> d, s -> rvertex left of the breakpoint and cvertex -> rvertex right of
    it; cedge is cut by cvertex, whose own parent edge carries what is below it. An anti-join and a union.
    """
    cvertex = rvertex + 1
    (rs, rd), (cs, cd) = redge, cedge
    r = (F.col("src") == rs) & (F.col("dst") == rd)
    c = (F.col("src") == cs) & (F.col("dst") == cd)
    out = edges.where(~(r | c))
    row = lambda df, s, d, lo="lo", hi="hi": df.select(F.lit(s).cast("int").alias("src"), F.lit(d).cast("int").alias("dst"), F.expr(lo).alias("lo"), F.expr(hi).alias("hi")).where("lo < hi")
    on, back = edges.where(r), edges.where(c)
    right = f"greatest(lo, {breakpoint}D)"
    above = row(back, cs, cvertex).unionByName(row(on, cs, cvertex, right))
    out = out.unionByName(row(on, rvertex, rd)).unionByName(row(on, rs, rvertex, "lo", f"least(hi, {breakpoint}D)")).unionByName(row(on, cvertex, rvertex, right)).unionByName(row(back, cvertex, cd))
    return out.unionByName(simplify(above, ["src", "dst"]))


def convert(edges: DataFrame, edge: tuple[int, int], other: int, breakpoint: float) -> DataFrame:
    """Edges after gene conversion: the edge (s, d) takes what lies right of the breakpoint, the one from d's other
    parent keeps what lies left of it."""
    s, d = edge
    own = (F.col("src") == s) & (F.col("dst") == d)
    two = (F.col("src") == other) & (F.col("dst") == d)
    taken = edges.where(two).select(F.lit(s).cast("int").alias("src"), "dst", F.greatest("lo", F.lit(breakpoint)).alias("lo"), "hi")
    one = simplify(edges.where(own).unionByName(taken), ["src", "dst"])
    left = edges.where(two).withColumn("hi", F.least("hi", F.lit(breakpoint))).where("lo < hi")
    return edges.where(~(own | two)).unionByName(one).unionByName(left)
