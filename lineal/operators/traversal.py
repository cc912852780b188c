"""Walks over genealogies that take the edges a condition admits, from given vertices; marginal ancestors; descents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from .graph import LEVELS
from .intervals import overlaps
from .storage import followed, materialize, ranked, unused


def _levels(first: DataFrame, step) -> DataFrame:
    """All rows of first and of what step makes of each level's rows, each once. LEVELS levels a job, each job's
    rows in a table; ends when a level is empty."""
    out = [materialize(first.distinct())]
    level = out[0]
    while True:
        batch = []
        for k in range(LEVELS):
            level = step(level).distinct()
            batch.append(level.withColumn("_level", F.lit(k)))
        table = materialize(reduce(DataFrame.unionByName, batch))
        if table.isEmpty():
            break
        out.append(table.drop("_level"))
        level = table.where(F.col("_level") == LEVELS - 1).drop("_level")
    return reduce(DataFrame.unionByName, out).distinct()


def edges_down(edges: DataFrame, root: int | DataFrame, within: Column, admits: Column | None = None) -> DataFrame:
    """(src, dst, lo, hi) of the edges reached from a root downwards.

    edges: (src, dst, lo, hi, src_kind, ..). From a vertex, its child edges that satisfy `within` (an overlap with some places)
    are taken; the only child edge of a recombination vertex is taken in any case; `admits`, if given, must hold for each edge. An edge that
    isn't admitted ends the walk there.
    """
    ok = edges if admits is None else edges.where(admits)
    cols = ["src", "dst", "lo", "hi"]
    first = ok.where(within & ((F.col("src") == root) if isinstance(root, int) else F.lit(True)))
    first = first if isinstance(root, int) else first.join(root.select(F.col("v").alias("src")), "src", "left_semi")
    onward = materialize(ok.where(within | (F.col("src_kind") == "rec")).select(*cols))
    return _levels(first.select(*cols), lambda level: onward.join(level.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select(*cols))


def edges_up(edges: DataFrame, starts: DataFrame, within: Column, admits: Column | None = None) -> DataFrame:
    """(src, dst, lo, hi) of the edges reached from starting vertices (v) upwards: parent edges that satisfy `within`; the only parent
    edge of a coalescence vertex is taken in any case. edges: (src, dst, lo, hi, dst_kind, ..)."""
    ok = edges if admits is None else edges.where(admits)
    cols = ["src", "dst", "lo", "hi"]
    first = ok.where(within).join(starts.select(F.col("v").alias("dst")), "dst", "left_semi")
    onward = materialize(ok.where(within | (F.col("dst_kind") == "coal")).select(*cols))
    return _levels(first.select(*cols), lambda level: onward.join(level.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*cols))


def walks_down(edges: DataFrame, roots: DataFrame, sets: DataFrame, key: str, admits: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(_walk, src, dst) and (key, _walk): many walks in one pass, each from its root (key, v) downwards at its own set of places (key, lo, hi).

    As edges_down: child edges that overlap any interval of the walk's set are taken, and the only child edge of a recombination vertex in any case.
    A set matters by which of the edges' different stretches it overlaps, one bit each; different intervals are looked up once, and keys whose bits and roots
    are the same are one walk, named by the least of them. A level's rows are (walk, vertex) for all walks; they meet edges by vertex, and what is overlapped by walk and
    stretch. A walk without a non-empty interval has no first edge. Null keys walk nowhere.
    """
    ok = edges if admits is None else edges.where(admits)
    ok = materialize(ok.select("src", "dst", "lo", "hi", "src_kind").where("lo < hi"))
    stretches = materialize(ranked(ok.select("lo", "hi").distinct(), ["lo", "hi"], "_no"))
    places = materialize(sets.where(F.col(key).isNotNull() & (F.col("lo") < F.col("hi"))).select(F.col(key).alias("_key"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2")).distinct())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), bits.place_in_chunk(F.col("_no")) - 1)
    held = overlaps(stretches, places.select("lo2", "hi2").distinct(), []).groupBy("lo2", "hi2", bits.chunk_of(F.col("_no")).alias("chunk")).agg(F.bit_or(bit).alias("bits"))
    told = places.join(held, ["lo2", "hi2"]).groupBy("_key", "chunk").agg(F.bit_or("bits").alias("bits")).groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("chunk", "bits"))).alias("_held"))
    begin = roots.select(F.col(key).alias("_key"), "v").groupBy("_key").agg(F.sort_array(F.collect_set("v")).alias("_roots"))
    told = materialize(told.join(begin, "_key"))
    walks = materialize(told.groupBy("_held", "_roots").agg(F.min("_key").alias("_walk")))
    members = told.join(walks, ["_held", "_roots"]).select(F.col("_key").alias(key), "_walk")
    at = F.explode(bits.set_places(F.col("x.bits"))).alias("_at")
    asked = materialize(walks.select("_walk", F.explode("_held").alias("x")).select("_walk", "x.chunk", at).select("_walk", ((F.col("chunk") - 1) * bits.CHUNK + F.col("_at") + 1).cast("long").alias("_no")))
    onward = materialize(ok.join(stretches, ["lo", "hi"]).select("src", "dst", "_no"))
    passing = ok.where("src_kind = 'rec'").select("src", "dst")

    def step(level: DataFrame, always: bool = True) -> DataFrame:
        at = level.select("_walk", F.col("dst").alias("src"))
        found = at.join(onward, "src").join(asked, ["_walk", "_no"], "left_semi").select("_walk", "src", "dst")
        return found.unionByName(at.join(passing, "src").select("_walk", "src", "dst")) if always else found

    first = step(walks.select("_walk", F.explode("_roots").alias("dst")), always=False)
    return _levels(first, step), members


def edges_down_each(edges: DataFrame, roots: DataFrame, sets: DataFrame, key: str, admits: Column | None = None) -> DataFrame:
    """(key, src, dst): the edges of walks_down for each key."""
    walked, members = walks_down(edges, roots, sets, key, admits)
    return members.join(walked, "_walk").select(key, "src", "dst")


def with_kinds(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edges with the kinds and latitudes of both ends: src_kind, dst_kind, src_lat, dst_lat."""
    s = vertices.select(F.col("v").alias("src"), F.col("kind").alias("src_kind"), F.col("latitude").alias("src_lat"))
    d = vertices.select(F.col("v").alias("dst"), F.col("kind").alias("dst_kind"), F.col("latitude").alias("dst_lat"))
    return edges.join(s, "src").join(d, "dst")


def with_states(edges: DataFrame, sequences: DataFrame, first: int, last: int, name: str = "derived") -> DataFrame:
    """edges with whether the lower end is derived at any marker from first to last."""
    def mask(chunk):
        lo, hi = max(first - 1 - chunk * 64, 0), min(last - chunk * 64, 64)
        m = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        return m - (1 << 64) if m >> 63 else m

    chunks = range((first - 1) // 64, (last - 1) // 64 + 1)
    on = reduce(lambda a, b: a | b, ((F.col("chunk") == c) & (F.col("bits").bitwiseAND(F.lit(mask(c)).cast("long")) != 0) for c in chunks))
    held = sequences.groupBy(F.col("v").alias("dst")).agg(F.bool_or(on).alias(name))
    return edges.join(held, "dst", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_sides(edges: DataFrame, events: DataFrame) -> DataFrame:
    """edges with side_lo and side_hi: what each edge above a recombination vertex may carry; all places for others."""
    e = events.select(F.col("rvertex").alias("dst"), F.col("left_parent").alias("_left"), F.col("breakpoint").alias("_at"))
    left = F.col("src") == F.col("_left")
    out = edges.join(e, "dst", "left").withColumns({"side_lo": F.when(F.col("_left").isNull() | left, 0.0).otherwise(F.col("_at")), "side_hi": F.when(F.col("_left").isNull() | ~left, float("inf")).otherwise(F.col("_at"))})
    return out.drop("_left", "_at")


def rec_candidates(breakpoint: float, latitude: float) -> Column:
    """Condition on edges (src_lat, dst_kind, derived, side_lo, side_hi, lo, hi) on which a recombination with the derived state at the
    breakpoint may recoalesce above a latitude."""
    wild = (F.col("lo") <= breakpoint) & (F.col("hi") > breakpoint) & ~F.col("derived")
    off = (F.col("dst_kind") == "rec") & ~((F.col("side_lo") <= breakpoint) & (F.col("side_hi") > breakpoint))
    return ~wild & (F.col("src_lat") >= latitude) & ~off


def coal_candidates(src: int, dst: int, latitude: float) -> Column:
    """Condition on edges (src_lat, derived) on which the wild edge (src, dst) may recoalesce above a latitude."""
    return ~F.col("derived") & (F.col("src_lat") >= latitude) & ~((F.col("src") == src) & (F.col("dst") == dst))


def ancestors_in(edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, anc, v): ancestors of the starts (keys, v) along edges (keys, src, dst); each once. Paths may turn between edges of
    one key at will: there is no meeting of their intervals."""
    up = materialize(edges.select(*keys, F.col("dst").alias("anc"), F.col("src").alias("_up")))
    step = lambda level: level.join(up, [*keys, "anc"]).select(*keys, F.col("_up").alias("anc"), "v")
    return _levels(step(starts.select(*keys, F.col("v").alias("anc"), "v")), step)


def lowest_common(edges: DataFrame, sets: DataFrame, root: int, leaves: DataFrame | None = None) -> DataFrame:
    """(set_id, mrca): from the root downwards, always to the first child that still has the whole set (set_id, v) below it,
    along the given edges (src, dst), those of a stretch of places for instance.

    Vertices above a set are those that as many of its members reach as it has; the way down is a chain of
    smallest such children, followed by pointer doubling. A set of a leaf alone gets the leaf.
    """
    members = sets.distinct()
    one = edges.select("src", "dst").distinct()
    reach = ancestors_in(one, members.select("v").distinct(), [])
    above = members.join(reach, "v").select("set_id", "anc", "v").unionByName(members.select("set_id", F.col("v").alias("anc"), "v")).distinct()
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    whole = materialize(above.groupBy("set_id", "anc").agg(F.count(F.lit(1)).alias("c")).join(sizes, "set_id").where("c = n").select("set_id", "anc"))
    down = whole.select("set_id", F.col("anc").alias("dst")).join(one, "dst").join(whole.select("set_id", F.col("anc").alias("src")), ["set_id", "src"])
    ends = followed(down.groupBy("set_id", "src").agg(F.min("dst").alias("to")), ["set_id"], "src", "to")
    told = ends.where(F.col("src") == root).select("set_id", F.col("to").alias("mrca"))
    return sizes.select("set_id").join(told, "set_id", "left").select("set_id", F.coalesce("mrca", F.lit(root)).alias("mrca"))


def lowest_start(edges: DataFrame, states: DataFrame, latitudes: DataFrame) -> DataFrame:
    """(src, dst, rlat): the lowest latitude from which a recombination on each edge of a marginal tree (src, dst) may start: that of the
    vertex below which the tree branches or the state (v, derived) changes, after following only children."""
    only = edges.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.min("dst").alias("to")).where("c = 1")
    a = states.select(F.col("v").alias("src"), F.col("derived").alias("x"))
    b = states.select(F.col("v").alias("to"), F.col("derived").alias("y"))
    steps = only.join(a, "src").join(b, "to").where("x = y").select(F.col("src").alias("v"), "to")
    ends = followed(steps, [], "v", "to").select(F.col("v").alias("dst"), "to")
    lat = latitudes.select(F.col("v").alias("to"), F.col("latitude").alias("rlat"))
    return edges.select("src", "dst").join(ends, "dst", "left").withColumn("to", F.coalesce("to", "dst")).join(lat, "to").select("src", "dst", "rlat")


def edge_at(edges: DataFrame, asked: DataFrame, latitudes: DataFrame) -> DataFrame:
    """(id, src, dst): going down from an edge of a marginal tree by first children, the edge that spans a latitude.
    asked: (id, src, dst, at), at below the edge's upper end."""
    first = materialize(edges.groupBy(F.col("src").alias("_v")).agg(F.min("dst").alias("_to")).join(latitudes.select(F.col("v").alias("_to"), F.col("latitude").alias("_low")), "_to"))
    low = latitudes.select(F.col("v").alias("dst"), F.col("latitude").alias("low"))
    start = asked.select("id", "src", "dst", "at").join(low, "dst").select("id", "src", "dst", "at", "low")
    step = lambda level: level.where("at < low").join(first, F.col("dst") == F.col("_v")).select("id", F.col("dst").alias("src"), F.col("_to").alias("dst"), "at", F.col("_low").alias("low"))
    return _levels(start, step).where("low <= at").select("id", "src", "dst")


def uniform_weights(candidates: DataFrame, latitude: float) -> DataFrame:
    """(src, dst, log_p): candidates (src, dst, src_lat, dst_lat) that span a latitude, each as likely as the others."""
    some = candidates.where((F.col("dst_lat") <= latitude) & (F.col("src_lat") >= latitude)).select("src", "dst")
    (n,) = unused(some.columns, "_n")
    return some.crossJoin(F.broadcast(some.agg(F.count(F.lit(1)).alias(n)))).select("src", "dst", (-F.ln(n)).alias("log_p"))  # one row
