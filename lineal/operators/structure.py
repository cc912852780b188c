"""Structural events on recombination graphs, many at a time: recombinations, gene conversions, and what they change upstream."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from .sample import pos_to_idx
from .storage import Ranges, materialize, ranked

INF = float("inf")
_WIDE = ["lo", "hi", "a", "b"]


@dataclass(frozen=True)
class Graph:
    """A recombination graph.

    vertices: (v, kind, latitude); edges: (src, dst, lo, hi), an edge that carries nothing has one row with lo = hi = 0; masks: (v, src, lo, hi), what
    the edge from src to the recombination vertex v may carry (no row: nothing); sequences: (v, chunk, bits, mask), no row where mask would be 0.
    """

    vertices: DataFrame
    edges: DataFrame
    masks: DataFrame
    sequences: DataFrame


def islands(df: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, lo, hi, a, b): each owner's intervals merged where they touch, with the marker numbers a, b of their ends. An owner's rows meet in one task: for
    owners such as edges, which have few."""
    w = Window.partitionBy(*owner).orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = df.where("lo < hi").withColumn("_new", F.coalesce((F.col("lo") > top).cast("int"), F.lit(1)))
    told = begun.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.groupBy(*owner, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def _numbered(g: Graph, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges and masks with a, b: the markers from a to b - 1 lie in the interval. Unions and intersections make no new ends, so that
    positions are looked up once, and masks of intervals need no markers after."""
    ends = lambda df: df.select(F.explode(F.array("lo", "hi")).alias("pos"))
    every = ends(g.edges).unionByName(ends(g.masks)).distinct()
    last = markers.agg(F.max("position").alias("end"), F.max("idx").alias("n"))
    at = pos_to_idx(every, markers, ["pos"]).crossJoin(F.broadcast(last))  # one row
    at = materialize(at.select("pos", F.when(F.col("pos") > F.col("end"), F.col("n") + 1).otherwise(F.col("idx")).cast("int").alias("idx")), "ends")

    def numbers(df: DataFrame, name: str) -> DataFrame:
        low, high = at.select(F.col("pos").alias("lo"), F.col("idx").alias("a")), at.select(F.col("pos").alias("hi"), F.col("idx").alias("b"))
        return materialize(df.join(low, "lo").join(high, "hi"), name)

    return numbers(g.edges.select("src", "dst", "lo", "hi"), "edges"), numbers(g.masks.select("v", "src", "lo", "hi"), "masks")


def _flat_masks(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk, m): ones at the markers a to b - 1 of any of a key's rows."""
    first, last = F.floor((F.col("a") - 1) / bits.CHUNK), F.floor((F.col("b") - 2) / bits.CHUNK)
    cut = df.where("a < b").withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("chunk", F.col("chunk").cast("int"))
    low, high = (F.col(c) - 1 - F.col("chunk") * bits.CHUNK for c in ("a", "b"))
    one = lambda n: F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int"))
    upto = F.when(high >= bits.CHUNK, F.lit(-1).cast("long")).otherwise(F.bitwise_not(one(high)))
    return cut.withColumn("_m", upto.bitwiseAND(one(F.greatest(low, F.lit(0))))).groupBy(*keys, "chunk").agg(F.bit_or("_m").alias("m"))


def _either(base: DataFrame, name: str, touched: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of base whose `name` isn't touched, and new ones."""
    return base.join(touched.select(F.col("v").alias(name)), name, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


#: Rows on which the rounds that are left are done by one task.
ALONE = 100_000
_ARROW = pa.schema([("v", pa.int32()), ("what", pa.string()), ("src", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("a", pa.int32()), ("b", pa.int32()), ("chunk", pa.int32()), ("bits", pa.int64()), ("mask", pa.int64()), ("changed", pa.bool_()), ("round", pa.int32())])
_STATE = "v int, what string, src int, lo double, hi double, a int, b int, chunk int, bits long, mask long, changed boolean, round int"


def _above(vertices: DataFrame, front: DataFrame, edges: DataFrame, seqs: DataFrame, masks: DataFrame, wide) -> DataFrame | None:
    """Rows that the rounds from a frontier upwards read, as those of a state: kinds (k) of the vertices that are as high as it or higher, edges (e) below them, states (s) of
    both ends, masks (m) and the frontier (f). None if there are more than ALONE, or if an edge leads from one of the vertices to a lower one."""
    low = vertices.join(front, "v", "left_semi").agg(F.min("latitude").alias("low"), F.count("latitude").alias("n")).first()
    if low.n < front.count():
        return None
    high = vertices.where(F.col("latitude") >= low.low).select("v", "kind")
    if high.limit(ALONE + 1).count() > ALONE:
        return None
    high = materialize(high, "high")
    own = high.select("v")
    below = materialize(edges.join(own.select(F.col("v").alias("src")), "src", "left_semi"), "below")
    if not edges.join(own.select(F.col("v").alias("dst")), "dst", "left_semi").join(own.select(F.col("v").alias("src")), "src", "left_anti").isEmpty():
        return None
    ends = own.unionByName(below.select(F.col("dst").alias("v"))).distinct()
    parts = [wide(high.where("kind <> 'leaf'").select("v", F.when(F.col("kind") == "rec", 1).otherwise(0).alias("src")), "k"), wide(below.withColumnRenamed("dst", "v"), "e"), wide(seqs.join(ends, "v", "left_semi"), "s"), wide(masks.join(own, "v", "left_semi"), "m"), wide(front, "f")]
    rest = materialize(reduce(DataFrame.unionByName, parts), "rest")
    return rest if rest.limit(ALONE + 1).count() <= ALONE else None


def _joined(rows: list[tuple]) -> list[tuple]:
    """islands() of one owner's (lo, hi, a, b)."""
    out = []
    for lo, hi, a, b in sorted(x for x in rows if x[0] < x[1]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi), min(out[-1][2], a), max(out[-1][3], b))
        else:
            out.append((lo, hi, a, b))
    return out


def _rounds(first: int):
    """A function for mapInArrow that does the rounds of propagate(), from number `first` on, on all rows of _above(), and gives the state of what it touched."""
    whole = (1 << bits.CHUNK) - 1
    signed = lambda x: x - (1 << bits.CHUNK) if x >> bits.CHUNK - 1 else x

    def again(v, rec, edges, below, states, masks):
        """Parental edges {src: [(lo, hi, a, b)]} and states {chunk: (bits, mask)} of a vertex, from its children."""
        children = {c: edges[c, v] for c in below.get(v, ())}
        carried = _joined([x for rows in children.values() for x in rows])
        under = lambda src: [(max(lo, w), min(hi, h), max(a, x), min(b, y)) for lo, hi, a, b in carried for w, h, x, y in masks.get((v, src), ())]
        up = {src: (_joined(under(src)) if rec else carried) or [(0.0, 0.0, 1, 1)] for src in edges.above.get(v, ())}
        told = {}
        for c, rows in children.items():
            flat = {}
            for _, _, a, b in rows:
                for chunk in range((a - 1) // bits.CHUNK, (b - 2) // bits.CHUNK + 1) if a < b else ():
                    lo, hi = max(a - 1 - chunk * bits.CHUNK, 0), min(b - 1 - chunk * bits.CHUNK, bits.CHUNK)
                    flat[chunk] = flat.get(chunk, 0) | (1 << hi) - (1 << lo)
            for chunk, m in flat.items():
                if chunk in states.get(c, {}):
                    s, own = states[c][chunk]
                    x, y = told.get(chunk, (whole, 0))
                    told[chunk] = x & (s | ~(m & own) & whole), y | m & own
        return up, {chunk: (s & m, m) for chunk, (s, m) in told.items() if m}

    class Edges(dict):
        """(dst, src) -> [(lo, hi, a, b)]; above: dst -> [src]."""

        def __init__(self):
            super().__init__()
            self.above = {}

    def run(batches):
        edges, below, states, masks, rec, front = Edges(), {}, {}, {}, {}, set()
        for batch in batches:
            for r in batch.to_pylist():
                v, src, row = r["v"], r["src"], (r["lo"], r["hi"], r["a"], r["b"])
                if r["what"] == "e":
                    if (v, src) not in edges:
                        edges.above.setdefault(v, []).append(src)
                        below.setdefault(src, []).append(v)
                    edges.setdefault((v, src), []).append(row)
                elif r["what"] == "s":
                    states.setdefault(v, {})[r["chunk"]] = r["bits"] & whole, r["mask"] & whole
                elif r["what"] == "m":
                    masks.setdefault((v, src), []).append(row)
                elif r["what"] == "k":
                    rec[v] = src == 1
                else:
                    front.add(v)
        seen, k = {}, first
        carries = lambda x: {src: {row[:2] for row in rows} for src, rows in x.items()}
        while front:
            new = {v: again(v, rec[v], edges, below, states, masks) for v in front}
            changed = {v for v, (up, told) in new.items() if carries(up) != carries({s: edges[v, s] for s in up}) or told != states.get(v, {})}
            for v, (up, told) in new.items():
                edges.update({(v, src): rows for src, rows in up.items()})
                states[v], seen[v] = told, (k, v in changed)
            front, k = {p for v in changed for p in edges.above.get(v, ()) if p in rec}, k + 1
        out = [{"v": v, "what": "t", "round": n, "changed": c} for v, (n, c) in seen.items()]
        out += [{"v": v, "what": "e", "src": src} | dict(zip(_WIDE, row, strict=True)) for v in seen for src in edges.above.get(v, ()) for row in edges[v, src]]
        out += [{"v": v, "what": "s", "chunk": c, "bits": signed(s), "mask": signed(m)} for v in seen for c, (s, m) in states[v].items()]
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


def propagate(g: Graph, start: DataFrame, markers: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after its vertices `start` (v) have something new below them, and (v, round, changed) of all vertices looked at, as of the last time.

    What a coalescence vertex's parental edges carry is the union of what its child edges do, and for a recombination vertex that union under each
    edge's mask; states are those that all children have. A round makes the vertices of a frontier again, from their children as they are then; those whose
    fingerprint (of states and parental intervals) has changed pass on to their parents, and the others end it there. A vertex with several changed
    ones below it may be looked at more than once; the result is the same whatever the order, as it depends on the children alone. A round is one
    table with what was touched so far; all that is not above the start is left as it is. Once all that stands as high as the frontier or higher is ALONE
    rows at most, one task does the remaining rounds on them, however many there are: a chain of vertices above a root takes a round for each.
    """
    spark = g.edges.sparkSession
    edges, masks = _numbered(g, markers)
    seqs = materialize(g.sequences.where("mask <> 0").select("v", "chunk", "bits", "mask"), "sequences")
    kinds = g.vertices.select("v", "kind")
    parents = materialize(edges.select("src", "dst").distinct(), "parents")
    inner = lambda df: df.join(kinds.where("kind <> 'leaf'").select("v"), "v", "left_semi").distinct()
    front = materialize(inner(start.select(F.col("v").cast("int").alias("v"))), "front")
    state, k = spark.createDataFrame([], _STATE), 0
    small = lambda df: df.limit(ALONE + 1).count() <= ALONE
    cols = state.columns
    wide = lambda df, what: df.select(*(F.lit(what).alias("what") if c == "what" else F.col(c) if c in df.columns else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in cols))
    while not front.isEmpty():
        k += 1
        touched = state.where("what = 't'").select("v")
        of_edges = state.where("what = 'e'").select("src", F.col("v").alias("dst"), *_WIDE)
        now_e, now_s = _either(edges, "dst", touched, of_edges), _either(seqs, "v", touched, state.where("what = 's'"))
        rest = _above(g.vertices, front, now_e, now_s, masks, wide) if small(front) else None
        if rest is not None:
            done = materialize(rest.repartition(1).mapInArrow(_rounds(k), _STATE), "above")
            kept = state.join(done.where("what = 't'").select("v"), "v", "left_anti").select(*cols)
            state = materialize(kept.unionByName(done), "state")
            break
        below = now_e.join(front.select(F.col("v").alias("src")), "src", "left_semi")
        carried = islands(below.select(F.col("src").alias("v"), *_WIDE), ["v"])
        above = parents.join(front.select(F.col("v").alias("dst")), "dst", "left_semi").select("src", F.col("dst").alias("v")).join(kinds, "v")
        meet = carried.join(above.where("kind <> 'rec'").select("v", "src"), "v").select("v", "src", *_WIDE)
        side = masks.select("v", "src", F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("a").alias("x"), F.col("b").alias("y"))
        under = carried.join(side, "v").select("v", "src", F.greatest("lo", "l").alias("lo"), F.least("hi", "h").alias("hi"), F.greatest("a", "x").alias("a"), F.least("b", "y").alias("b"))
        some = islands(meet.unionByName(under), ["v", "src"])
        new_e = above.select("v", "src").join(some, ["v", "src"], "left").select("v", "src", *(F.coalesce(c, F.lit(z)).alias(c) for c, z in zip(_WIDE, (0.0, 0.0, 1, 1), strict=True)))
        child = now_s.select(F.col("v").alias("dst"), "chunk", F.col("bits").alias("s"), F.col("mask").alias("own"))
        met = _flat_masks(below.select("src", "dst", "a", "b"), ["src", "dst"]).join(child, ["dst", "chunk"])
        on = F.col("m").bitwiseAND(F.col("own"))
        new_s = met.groupBy(F.col("src").alias("v"), "chunk").agg(F.bit_and(F.col("s").bitwiseOR(F.bitwise_not(on))).alias("s"), F.bit_or(on).alias("mask")).where("mask <> 0")
        new_s = new_s.select("v", "chunk", F.col("s").bitwiseAND(F.col("mask")).alias("bits"), "mask")
        new = wide(new_e, "e").unionByName(wide(new_s, "s"))
        old = wide(now_e.join(front.select(F.col("v").alias("dst")), "dst", "left_semi").withColumnRenamed("dst", "v"), "e").unionByName(wide(now_s.join(front, "v", "left_semi"), "s"))
        row = F.xxhash64("what", "src", "lo", "hi", "chunk", "bits", "mask")
        print_ = lambda df, sign: df.groupBy("v").agg(F.bit_xor(row).alias("x"), F.sum(row % F.lit(1 << 31)).alias("y")).select("v", F.struct("x", "y").alias(sign))
        seen = front.join(print_(new, "after"), "v", "left").join(print_(old, "before"), "v", "left").select("v", (~F.col("after").eqNullSafe(F.col("before"))).alias("changed"), F.lit(k).alias("round"))
        kept = state.join(front, "v", "left_anti").select(*cols)
        state = materialize(kept.unionByName(new).unionByName(wide(seen, "t")), "state")
        moved = state.where(f"what = 't' and changed and round = {k}").select(F.col("v").alias("dst"))
        front = materialize(inner(parents.join(moved, "dst", "left_semi").select(F.col("src").alias("v"))), "front")
    touched = state.where("what = 't'")
    of_edges = state.where("what = 'e'").select("src", F.col("v").alias("dst"), *_WIDE)
    out = replace(g, edges=_either(edges, "dst", touched, of_edges).select("src", "dst", "lo", "hi"), sequences=_either(seqs, "v", touched, state.where("what = 's'")))
    return out, touched.select("v", "round", "changed")


def convert_all(g: Graph, conversions: DataFrame, markers: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after gene conversions (event, src, dst, other, breakpoint), and the vertices looked at: the edge from src to the recombination vertex dst takes what
    lies right of the breakpoint besides what it has, the one from other keeps what lies left of it. Conversions of one vertex follow each
    other by event, all vertices at a time. Masks change, and what edges carry follows from them upstream; so a mask may come to have several stretches, or none.
    """
    order = Window.partitionBy("dst").orderBy("event")
    told = materialize(conversions.select("event", "src", "dst", "other", "breakpoint").withColumn("turn", F.row_number().over(order)), "conversions")
    masks = g.masks.select("v", "src", "lo", "hi")
    for turn in range(1, (told.agg(F.max("turn")).first()[0] or 0) + 1):
        now = told.where(F.col("turn") == turn)
        more = now.select(F.col("dst").alias("v"), "src", F.col("breakpoint").alias("lo"), F.lit(INF).alias("hi"))
        taken = more.join(masks.select("v", "src"), ["v", "src"], "left").distinct().select("v", "src", "lo", "hi").unionByName(masks.join(more.select("v", "src"), ["v", "src"], "left_semi").select("v", "src", "lo", "hi"))
        joined = islands(taken.withColumns({"a": F.lit(0), "b": F.lit(0)}), ["v", "src"]).drop("a", "b")
        cut = now.select(F.col("dst").alias("v"), F.col("other").alias("src"), "breakpoint")
        kept = masks.join(cut, ["v", "src"]).select("v", "src", "lo", F.least("hi", "breakpoint").alias("hi")).where("lo < hi")
        rest = masks.join(more.select("v", "src").unionByName(cut.select("v", "src")), ["v", "src"], "left_anti").select("v", "src", "lo", "hi")
        masks = materialize(rest.unionByName(joined).unionByName(kept), "masks")
    return propagate(replace(g, masks=masks), told.select(F.col("dst").alias("v")), markers)


def numbered_events(events: DataFrame, vertices: DataFrame) -> DataFrame:
    """events (event, ..) with rvertex and cvertex, the next two numbers above the vertices' for each, by event."""
    top = vertices.agg(F.max("v").alias("_top"))
    told = ranked(events, ["event"], "_rank").crossJoin(F.broadcast(top))  # one row
    return told.withColumns({"rvertex": (F.col("_top") + 2 * F.col("_rank") - 1).cast("int"), "cvertex": (F.col("_top") + 2 * F.col("_rank")).cast("int")}).drop("_top", "_rank")


def _cut(parents: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parents (src, dst) after their edges are cut by vertices (src, dst, lat, x), lowest first, and (src, dst, x) of each edge's lowest. A null src is
    above a root. Vertices of an edge are dealt by ranges of latitude, so an edge may have any number."""
    dealt = Ranges(cuts.select(F.coalesce("src", F.lit(0)).alias("src"), "dst", "lat", "x"), ["src", "dst"], ["lat", "x"])
    chain = materialize(dealt.running(dealt.rows, "under", F.col("x"), "last", before=True).select("src", "dst", "lat", "x", "under"), "chains")
    inner = chain.select(F.col("x").alias("src"), F.coalesce("under", "dst").alias("dst"))
    tops = chain.where("src <> 0").groupBy("src", "dst").agg(F.max_by("x", F.struct("lat", "x")).alias("x")).select("src", F.col("x").alias("dst"))
    left = parents.join(chain.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst")
    return left.unionByName(inner).unionByName(tops), chain.where("under is null").select("src", "dst", "x")


def recombine_all(g: Graph, events: DataFrame, markers: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after recombinations (event, rsrc, rdst, csrc, cdst, breakpoint, rlat, clat), and the vertices looked at.

    Each event has two new vertices, numbered by event: the recombination vertex cuts the edge from rsrc to rdst at rlat, the recoalescence vertex the one from csrc to cdst at
    clat (csrc null: there is none, cdst is the root, and the vertex goes above it and becomes the root), and an edge leads from the second down to the first. That
    edge carries what lies right of the breakpoint, the recombination vertex's other parental edge what lies left.

    All events are applied together. Those that name one edge stand on it in order of latitude, then of number. Events may name edges that others of them make
    (the numbers of new vertices are known beforehand): these are cut in a further pass, once they are there. Where the edge above an older recombination vertex is
    cut, its mask goes over to the piece that is left above the vertex. Intervals and states follow by propagate(). An event that names an edge
    which never exists raises ValueError, and so does one whose latitudes do not lie on its edges; a null event or no events at all change nothing.
    """
    ev = materialize(numbered_events(events.where("event is not null"), g.vertices), "events")
    added = ev.select(F.explode(F.array(F.struct(F.col("rvertex").alias("v"), F.lit("rec").alias("kind"), F.col("rlat").alias("latitude")), F.struct(F.col("cvertex").alias("v"), F.lit("coal").alias("kind"), F.col("clat").alias("latitude")))).alias("x")).select("x.*")
    vertices = materialize(g.vertices.select("v", "kind", "latitude").unionByName(added), "vertices")
    ends = lambda s, d, lat, x: F.struct(F.col(s).cast("int").alias("src"), F.col(d).cast("int").alias("dst"), F.col(lat).alias("lat"), F.col(x).alias("x"))
    waiting = materialize(ev.select(F.explode(F.array(ends("rsrc", "rdst", "rlat", "rvertex"), ends("csrc", "cdst", "clat", "cvertex"))).alias("x")).select("x.*"), "cuts")
    links = ev.select(F.col("cvertex").alias("src"), F.col("rvertex").alias("dst"))
    parents = materialize(g.edges.select("src", "dst").distinct(), "parents")
    carried = g.edges.select("src", "dst", "lo", "hi")
    masks = g.masks.select("v", "src", "lo", "hi")
    right = ev.select(F.col("rvertex").alias("v"), F.col("cvertex").alias("src"), F.col("breakpoint").alias("lo"), F.lit(INF).alias("hi"))
    # what stands on a cut edge, what is above it, and the root that gets its first parent
    starts = [added.select("v"), waiting.select(F.coalesce("src", "dst").alias("v"))]
    first = True
    while not waiting.isEmpty():
        roots = parents.select(F.col("src").alias("v")).distinct().join(parents.select(F.col("dst").alias("v")), "v", "left_anti") if first else None
        named = waiting.join(parents, ["src", "dst"], "left_semi").select(*waiting.columns)
        if first:
            named = named.unionByName(waiting.where("src is null").join(roots.select(F.col("v").alias("dst")), "dst", "left_semi").select(*waiting.columns))
        ready = materialize(named, "ready")
        if ready.isEmpty():
            raise ValueError(f"events name edges that never exist: {[tuple(r)[:2] for r in waiting.limit(5).collect()]}")
        cut, lowest = _cut(parents, ready)
        move = lowest.where("src <> 0")
        rekeyed = lambda df, key, moved=move: df.join(moved.withColumnRenamed("dst", key), [key, "src"], "left").withColumn("src", F.coalesce("x", "src")).drop("x")
        masks = rekeyed(masks.unionByName(right) if first else masks, "v").select("v", "src", "lo", "hi")
        carried = rekeyed(carried, "dst").select("src", "dst", "lo", "hi")
        masks, carried = materialize(masks, "masks"), materialize(carried, "edges")
        parents = materialize(cut.unionByName(links) if first else cut, "parents")
        waiting = materialize(waiting.join(ready.select("x"), "x", "left_anti").select(*waiting.columns), "cuts")
        first = False
    # the other parental edge of each new recombination vertex, wherever it has gone
    own = parents.join(ev.select(F.col("rvertex").alias("dst"), "breakpoint"), "dst").join(masks.select(F.col("v").alias("dst"), "src"), ["dst", "src"], "left_anti")
    masks = masks.unionByName(own.select(F.col("dst").alias("v"), "src", F.lit(0.0).alias("lo"), F.col("breakpoint").alias("hi")))
    empty = parents.join(carried, ["src", "dst"], "left_anti").select("src", "dst", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    lat = lambda c: vertices.select(F.col("v").alias(c), F.col("latitude").alias(f"_{c}"))
    fresh = parents.join(added.select(F.col("v").alias("src")), "src", "left_semi").unionByName(parents.join(added.select(F.col("v").alias("dst")), "dst", "left_semi"))
    bad = fresh.join(lat("src"), "src").join(lat("dst"), "dst").where("_dst > _src").limit(5).collect()  # 5 rows at most
    if bad:
        raise ValueError(f"events whose latitudes don't lie on their edges: {[(r.src, r.dst) for r in bad]}")
    made = Graph(vertices, carried.unionByName(empty), masks, g.sequences)
    return propagate(made, reduce(DataFrame.unionByName, [s.select(F.col("v").cast("int").alias("v")) for s in starts]), markers)


def side_masks(events: DataFrame) -> DataFrame:
    """masks of a graph from events (rvertex, left_parent, right_parent, breakpoint)."""
    side = lambda src, lo, hi: F.struct(F.col("rvertex").cast("int").alias("v"), F.col(src).cast("int").alias("src"), lo.alias("lo"), hi.alias("hi"))
    both = F.array(side("left_parent", F.lit(0.0), F.col("breakpoint")), side("right_parent", F.col("breakpoint"), F.lit(INF)))
    return events.select(F.explode(both).alias("x")).select("x.*")


