"""Sequences of all vertices, mutations on edges and consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits
from .sample import interval_masks, markers_in
from .storage import Ranges, materialize


def vertex_sequences(closure_: DataFrame, haplotypes: DataFrame, markers: DataFrame) -> DataFrame:
    """(v, chunk, bits, mask): the AND, over the leaves reached at each marker, of their packed sequences; mask has
    ones where any leaf is reached. The masks of the few different intervals are made once, and rows are combined
    map-side by bit_and."""
    reach = closure_.select("anc", F.col("v").alias("leaf"), F.struct("lo", "hi").alias("k"))
    masks = interval_masks(reach.select("k").distinct().select("k", "k.lo", "k.hi"), markers, "k")
    flat = masks.select("k", F.posexplode("mask").alias("chunk", "m"))
    h = haplotypes.select(F.col("v").alias("leaf"), F.posexplode("chunks").alias("chunk", "b"))
    met = reach.join(flat, "k").join(h, ["leaf", "chunk"])
    out = met.groupBy(F.col("anc").alias("v"), "chunk").agg(F.bit_and(F.col("b").bitwiseOR(F.bitwise_not("m"))).alias("b"), F.bit_or("m").alias("mask"))
    return out.select("v", "chunk", F.col("b").bitwiseAND(F.col("mask")).alias("bits"), "mask")


def long_sequences(sequences: DataFrame) -> DataFrame:
    """(v, idx, derived) at the markers that each vertex is ancestral at."""
    bit = lambda c, i: F.call_function("shiftrightunsigned", F.col(c), i).bitwiseAND(F.lit(1).cast("long")) == 1
    every = sequences.withColumn("i", F.explode(bits.set_places(F.col("mask"))))
    return every.select("v", (F.col("chunk") * bits.CHUNK + F.col("i") + 1).cast("int").alias("idx"), bit("bits", F.col("i")).alias("derived"))


def edge_differences(edges: DataFrame, sequences: DataFrame, markers: DataFrame) -> DataFrame:
    """(src, dst, chunk, x): markers within each edge's intervals at which its ends differ, packed."""
    cut = edges.select("src", "dst", F.struct("lo", "hi").alias("k"))
    masks = interval_masks(cut.select("k").distinct().select("k", "k.lo", "k.hi"), markers, "k").select("k", F.posexplode("mask").alias("chunk", "m"))
    s = sequences.select(F.col("v").alias("src"), "chunk", F.col("bits").alias("a"))
    d = sequences.select(F.col("v").alias("dst"), "chunk", F.col("bits").alias("b"))
    met = cut.join(masks, "k").join(s, ["src", "chunk"]).join(d, ["dst", "chunk"])
    return met.groupBy("src", "dst", "chunk").agg(F.bit_or(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.col("m"))).alias("x"))


def mutation_edges(differences: DataFrame) -> DataFrame:
    """(idx, src, dst) of each mutation."""
    some = differences.where("x <> 0").withColumn("i", F.explode(bits.set_places(F.col("x"))))
    return some.select((F.col("chunk") * bits.CHUNK + F.col("i") + 1).cast("int").alias("idx"), "src", "dst")


def next_inconsistent(mutations: DataFrame, events: DataFrame, idx: int = 1) -> DataFrame:
    """(idx, src, dst): the mutation edges of the first marker from idx on that has more than one; edges
    above recombination vertices' children don't count."""
    told = mutations.join(events.select(F.col("rvertex").alias("src")), "src", "left_anti").where(F.col("idx") >= idx)
    first = told.groupBy("idx").count().where("count > 1").agg(F.min("idx").alias("idx"))
    return told.join(F.broadcast(first), "idx").select("idx", "src", "dst")


def next_inconsistent_from(edges: DataFrame, sequences: DataFrame, markers: DataFrame, events: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, idx, src, dst): for each start (a marker's number), the mutation edges of the first marker from there on that has more than one;
    edges above recombination vertices' children don't count. Starts without such a marker have no row.

    Chunks of markers are looked at from the least start on, and the search ends with the chunk in which the last start is answered: batches
    of chunks double in length, so it reads at most about twice the chunks it needs, in a number of jobs that grows like their logarithm.
    Sequences (v, chunk, bits, ..) are read for the chunks of a batch alone: a table partitioned by chunk is pruned.
    """
    counted = materialize(edges.join(events.select(F.col("rvertex").alias("src")), "src", "left_anti").select("src", "dst", "lo", "hi"), "edges")
    last = markers.agg(F.max("idx").alias("m")).first().m or 0
    open_ = materialize(starts.select("start").where("start is not null").distinct(), "starts")
    out, chunk, length = [], None, 1
    while True:
        least = open_.agg(F.min("start").alias("s")).first().s
        if least is None:
            break
        chunk = max(chunk or 0, (max(least, 1) - 1) // bits.CHUNK)
        if chunk * bits.CHUNK >= last:
            break
        end = chunk + length
        some = markers.where((F.col("idx") > max(chunk * bits.CHUNK, least - 1)) & (F.col("idx") <= end * bits.CHUNK))
        found = mutation_edges(chunk_differences(counted, sequences.where((F.col("chunk") >= chunk) & (F.col("chunk") < end)), some))
        found = materialize(found, "mutations")
        twice = found.groupBy("idx").count().where("count > 1").select("idx")
        # a start's answer is the next such marker: both stand in one order, dealt by ranges, falling
        both = twice.select((-F.col("idx")).alias("_at"), F.lit(0).alias("_kind"), "idx").unionByName(open_.select((-F.col("start")).alias("_at"), F.lit(1).alias("_kind"), "start"), allowMissingColumns=True)
        dealt = Ranges(both, [], ["_at", "_kind"])
        told = dealt.running(dealt.rows, "hit", F.col("idx"), "last").where("_kind = 1 and hit is not null").select("start", F.col("hit").alias("idx"))
        told = materialize(told, "starts")
        out.append(materialize(told.join(found, "idx").select("start", "idx", "src", "dst"), "mutations"))
        open_ = materialize(open_.join(told, "start", "left_anti"), "starts")
        chunk, length = end, 2 * length
    empty = counted.where(F.lit(False)).select(F.lit(0).alias("start"), F.lit(0).alias("idx"), "src", "dst")
    return reduce(DataFrame.unionByName, out, empty) if out else empty


def chunk_differences(edges: DataFrame, sequences: DataFrame, markers: DataFrame) -> DataFrame:
    """(src, dst, chunk, x) as edge_differences, at the given markers alone; rows without a difference are left out."""
    cut = edges.select("src", "dst", F.struct("lo", "hi").alias("k"))
    hit = markers_in(cut.select("k").distinct().select("k", "k.lo", "k.hi"), markers, ["k"])
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bits.place_in_chunk(F.col("idx")) - 1).cast("int"))
    masks = hit.groupBy("k", (bits.chunk_of(F.col("idx")) - 1).alias("chunk")).agg(F.bit_or(one).alias("m"))
    s = sequences.select(F.col("v").alias("src"), "chunk", F.col("bits").alias("a"))
    d = sequences.select(F.col("v").alias("dst"), "chunk", F.col("bits").alias("b"))
    met = cut.join(masks, "k").join(s, ["src", "chunk"]).join(d, ["dst", "chunk"])
    return met.groupBy("src", "dst", "chunk").agg(F.bit_or(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.col("m"))).alias("x")).where("x <> 0")


def breakpoint_bounds(pairs: DataFrame, stops: DataFrame) -> DataFrame:
    """(pair, right_idx, left_idx): going left from right_idx, the nearest marker that stops (0: none). pairs: (pair, right_idx);
    stops: (pair, idx), see bound_stops."""
    met = pairs.join(stops, "pair", "left").groupBy("pair", "right_idx").agg(F.max(F.when(F.col("idx") < F.col("right_idx"), F.col("idx"))).alias("l"))
    return met.select("pair", "right_idx", F.coalesce("l", F.lit(0)).alias("left_idx"))


def bound_stops(pairs: DataFrame, sequences: DataFrame, markers: DataFrame) -> DataFrame:
    """(pair, idx): markers at which the lower ends of two edges differ, or that the second edge isn't ancestral at.
    pairs: (pair, rdst, cdst, lo, hi), lo and hi of the second edge (null: it is not in the graph, and all markers count as ancestral)."""
    k = pairs.select("pair", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(float("inf"))).alias("hi"))
    masks = interval_masks(k, markers, "pair").select("pair", "n", F.posexplode("mask").alias("chunk", "m"))
    s = sequences.select(F.col("v").alias("rdst"), "chunk", F.col("bits").alias("a"))
    d = sequences.select(F.col("v").alias("cdst"), "chunk", F.col("bits").alias("b"))
    met = pairs.select("pair", "rdst", "cdst").join(masks, "pair").join(s, ["rdst", "chunk"], "left").join(d, ["cdst", "chunk"], "left")
    zero = F.lit(0).cast("long")
    x = F.coalesce("a", zero).bitwiseXOR(F.coalesce("b", zero)).bitwiseOR(F.bitwise_not("m"))
    every = met.withColumn("x", x).withColumn("i", F.explode(bits.set_places(F.col("x"))))
    idx = (F.col("chunk") * bits.CHUNK + F.col("i") + 1).cast("int")
    return every.where(idx <= F.col("n")).select("pair", idx.alias("idx"))


def pair_mutations(a: Column, b: Column, mask: Column | None = None) -> Column:
    """Number of markers at which two packed sequences differ, under a mask if one is given."""
    x = bits.xor_(a, b)
    return bits.popcount(x if mask is None else bits.and_(x, mask))


def differs_at(edges: DataFrame, sequences: DataFrame, idx: int, name: str = "is_mutation") -> DataFrame:
    """edges with whether the sequences of their ends differ at a marker."""
    chunk, place = divmod(idx - 1, bits.CHUNK)
    bit = F.call_function("shiftrightunsigned", F.col("bits"), F.lit(place)).bitwiseAND(F.lit(1).cast("long"))
    s = sequences.where(F.col("chunk") == chunk).select("v", bit.alias("b"))
    out = edges.join(s.select(F.col("v").alias("src"), F.col("b").alias("_a")), "src", "left").join(s.select(F.col("v").alias("dst"), F.col("b").alias("_b")), "dst", "left")
    return out.withColumn(name, F.coalesce("_a", F.lit(0)) != F.coalesce("_b", F.lit(0))).drop("_a", "_b")


def equal_under_masks(pairs: DataFrame, sequences: DataFrame, masks: DataFrame) -> DataFrame:
    """(v1, v2, equal): whether two vertices have the same states at all markers that both are ancestral at.
    pairs: (v1, v2); masks: (v, n, mask)."""
    flat = masks.select("v", F.posexplode("mask").alias("chunk", "m")).join(sequences.select("v", "chunk", "bits"), ["v", "chunk"], "left").select("v", "chunk", "m", F.coalesce("bits", F.lit(0).cast("long")).alias("b"))
    one, two = (flat.select(F.col("v").alias(f"v{i}"), "chunk", F.col("m").alias(f"m{i}"), F.col("b").alias(f"b{i}")) for i in (1, 2))
    apart = F.col("b1").bitwiseXOR(F.col("b2")).bitwiseAND(F.col("m1")).bitwiseAND(F.col("m2"))
    return pairs.join(one, "v1").join(two, ["v2", "chunk"]).groupBy("v1", "v2").agg((F.bit_or(apart) == 0).alias("equal"))


def edgesmap(edges: DataFrame) -> DataFrame:
    """(src, dst, number): edges numbered from 1 by parent and child, by offsets of parents' counts."""
    e = edges.select("src", "dst").distinct()
    per = e.groupBy("src").count().withColumn("part", F.floor(F.col("src") / 1000))
    parts = per.groupBy("part").agg(F.sum("count").alias("s"))
    big = parts.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("big"))
    off = per.withColumn("own", F.sum("count").over(Window.partitionBy("part").orderBy("src")) - F.col("count")).join(big, "part").select("src", (F.col("big") + F.col("own")).alias("off"))
    k = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    return e.withColumn("k", k).join(off, "src").select("src", "dst", (F.col("off") + F.col("k")).cast("long").alias("number"))
