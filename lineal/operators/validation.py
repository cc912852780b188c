"""Rules that genealogies obey, as counts of rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import degrees, with_latitudes
from .intervals import simplify
from .sample import interval_masks

TREE_RULES = ["latitudes rise with vertex numbers", "children lie below parents", "children have smaller numbers", "root has two children", "internal vertices have two children and a parent", "leaves have a parent alone", "one root"]
GRAPH_RULES = ["leaves have a parent alone", "leaves carry all places", "coalescences have two children and a parent, if any", "recombinations have a child and two parents", "children lie below parents", "parental intervals are unions of child intervals", "states are those that all children have", "leaf sequences are those of the sample", "one mutation per marker", "one root"]


def _broken(df: DataFrame, **rules: Column) -> DataFrame:
    """(at, violations): one row for each rule, r and its number, all counted in one pass by its aggregate; null is none."""
    one = df.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in rules.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("at"), F.col(k).alias("violations")) for k in rules))))


def _named(names: list[str], parts: list[DataFrame]) -> DataFrame:
    """(rule, violations) of parts whose column `at` is r and the rule's number."""
    named = F.element_at(F.array(*map(F.lit, names)), F.substring("at", 2, 2).cast("int") + 1)
    return reduce(DataFrame.unionByName, parts).select(named.alias("rule"), "violations")


def _roots() -> Column:
    return F.when(F.count_if(F.col("n_dads") == 0) != 1, 1)


def tree_violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, violations) of a tree. Rules on degrees are one pass over vertices."""
    n, inner = F.count(F.lit(1)), vertices.where("kind = 'coal'")
    before = inner.select((F.col("v") + 1).alias("v"), F.col("latitude").alias("below"))
    by_degree = {"r3": "n_dads = 0 and n_children <> 2", "r4": "kind = 'coal' and n_dads > 0 and (n_children <> 2 or n_dads <> 1)", "r5": "kind = 'leaf' and (n_children <> 0 or n_dads <> 1)"}
    return _named(TREE_RULES, [
        _broken(inner.join(before, "v").where("latitude < below"), r0=n),
        _broken(with_latitudes(edges, vertices).where("dst_lat > src_lat"), r1=n),
        _broken(edges.where("dst >= src"), r2=n),
        _broken(degrees(edges, vertices), **{r: F.count_if(F.expr(c)) for r, c in by_degree.items()}, r6=_roots()),
    ])


def _unlike_intervals(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, lo, hi) in which the union of a coalescence vertex's child intervals and that of its parental ones differ."""
    inner = edges.select(F.col("dst").alias("v")).distinct().join(vertices.where("kind = 'coal'").select("v"), "v")
    below = simplify(edges.select(F.col("src").alias("v"), "lo", "hi"), ["v"]).join(inner, "v", "left_semi")
    above = simplify(edges.select(F.col("dst").alias("v"), "lo", "hi"), ["v"]).join(inner, "v", "left_semi")
    both = below.withColumn("s", F.lit(1)).unionByName(above.withColumn("s", F.lit(2)))
    return both.groupBy("v", "lo", "hi").agg(F.sum("s").alias("s")).where("s <> 3")


def _unlike_states(edges: DataFrame, sequences: DataFrame, markers: DataFrame) -> DataFrame:
    """(v, chunk) of inner vertices whose states at their markers are not the AND of their children's, each under its edge's mask."""
    k = edges.select("src", "dst", F.struct("lo", "hi").alias("k"))
    masks = interval_masks(k.select("k").distinct().select("k", "k.lo", "k.hi"), markers, "k").select("k", F.posexplode("mask").alias("chunk", "m"))
    child = sequences.select(F.col("v").alias("dst"), "chunk", F.col("bits").alias("b"))
    met = k.join(masks, "k").join(child, ["dst", "chunk"], "left")
    want = met.groupBy(F.col("src").alias("v"), "chunk").agg(F.bit_and(F.coalesce("b", F.lit(0).cast("long")).bitwiseOR(F.bitwise_not("m"))).alias("want"), F.bit_or("m").alias("own"))
    told = want.join(sequences.select("v", "chunk", "bits"), ["v", "chunk"], "left")
    return told.where(F.coalesce("bits", F.lit(0).cast("long")).bitwiseAND(F.col("own")) != F.col("want").bitwiseAND(F.col("own")))


def graph_violations(vertices: DataFrame, edges: DataFrame, sequences: DataFrame, mutations: DataFrame, haplotypes: DataFrame, markers: DataFrame) -> DataFrame:
    """(rule, violations) of a recombination graph. A consistent one has one mutation per marker; others
    are told how many markers have more or none."""
    n, none = F.count(F.lit(1)), F.lit(0).cast("long")
    leaf = vertices.where("kind = 'leaf'").select(F.col("v").alias("dst"))
    h = haplotypes.select("v", F.posexplode("chunks").alias("chunk", "b"))
    per = markers.select("idx").join(mutations.groupBy("idx").count(), "idx", "left")
    by_degree = {"r0": "kind = 'leaf' and (n_children <> 0 or n_dads <> 1)", "r2": "kind = 'coal' and (n_children <> 2 or n_dads > 1)", "r3": "kind = 'rec' and (n_children <> 1 or n_dads <> 2)"}
    return _named(GRAPH_RULES, [
        _broken(degrees(edges, vertices), **{r: F.count_if(F.expr(c)) for r, c in by_degree.items()}, r9=_roots()),
        _broken(edges.where((F.col("lo") != 0) | (F.col("hi") != float("inf"))).join(leaf, "dst", "left_semi"), r1=n),
        _broken(with_latitudes(edges, vertices).where("dst_lat > src_lat"), r4=n),
        _broken(_unlike_intervals(edges, vertices), r5=n),
        _broken(_unlike_states(edges, sequences, markers), r6=n),
        _broken(h.join(sequences, ["v", "chunk"], "left").where(F.coalesce("bits", none) != F.col("b")), r7=n),
        _broken(per, r8=F.count_if(F.coalesce("count", none) != 1)),
    ])
