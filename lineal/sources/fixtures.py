"""Relations derived from the given tables: a sample of haplotypes, a tree and a graph over its leaves,
interval sets, positions, a distribution and a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..operators.graph import arg_from_tree
from ..operators.storage import materialize, ranked, running

MARKERS = 64
#: Minutes are counted from here.
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, n, chunks): sign-binarised embeddings, packed without a shuffle."""
    flags = F.transform("embedding", lambda x: x > 0)
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("v"), F.size("embedding").alias("n"), bits.pack(flags).alias("chunks"))


def long_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, idx, derived)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") + 1).cast("int").alias("v"), F.posexplode("embedding").alias("p", "x")).select("v", (F.col("p") + 1).alias("idx"), (F.col("x") > 0).alias("derived"))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, position): position = idx."""
    e = table(spark, sf_dir, "embeddings")
    longest = e.agg(F.max(F.size("embedding")).alias("m"))
    return longest.select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("idx")).withColumn("position", F.col("idx").cast("double"))


#: Each element gives a marker for each of these thresholds, in this order, in wide haplotypes.
THRESHOLDS = (0.0, 0.1, -0.1, 0.05, -0.05)


def wide_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, n, chunks) with several markers an element, in several chunks: derived where the element exceeds the marker's threshold."""
    flags = F.flatten(F.transform("embedding", lambda x: F.array(*(x > t for t in THRESHOLDS))))
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("v"), flags.alias("flags"))
    return e.select("v", F.size("flags").alias("n"), bits.pack(F.col("flags")).alias("chunks"))


def wide_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, position) of wide haplotypes, as close together as lets an element's last marker stand at its place."""
    m = markers(spark, sf_dir)
    k = len(THRESHOLDS)
    return m.select(F.explode(F.sequence((F.col("idx") - 1) * k + 1, F.col("idx") * k)).alias("idx")).withColumn("position", F.col("idx") / k)


def place_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, lo, hi): each user's events as stretches of places, half a marker to ten markers wide."""
    e = event_intervals(spark, sf_dir)
    lo = F.col("lo") % 640 / 10
    return e.select("user_id", lo.alias("lo"), (lo + 0.5 + F.when(F.col("event_id") % 50 == 0, 9.5).otherwise(0.0)).alias("hi"))


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, lo, hi) in minutes."""
    # whole minutes, whatever the session's time zone
    lo = F.expr(f"cast(cast(cast(ts as timestamp_ntz) - timestamp_ntz'{EPOCH}' as interval minute) as bigint)").cast("double")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", lo.alias("lo"))
    return e.withColumn("hi", F.col("lo") + 1 + 15 * (F.col("event_id") % 90))


def price_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, position): the different retail prices in order."""
    p = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("position")).distinct()
    return ranked(p, ["position"], "idx").select(F.col("idx").cast("int").alias("idx"), "position")


def price_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, line, pos): positions to look up."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), (800 + F.col("l_extendedprice") % 300).alias("pos"))


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cfg, p): shares of four binary properties of line items, the first in the highest bit; all 16 rows."""
    li = table(spark, sf_dir, "lineitem")
    bit = lambda c, k: F.when(c, 1 << k).otherwise(0)
    cfg = bit(F.col("l_returnflag") == "R", 3) + bit(F.col("l_linestatus") == "O", 2) + bit(F.col("l_discount") > 0.05, 1) + bit(F.col("l_quantity") > 25, 0)
    counts = li.groupBy(cfg.cast("long").alias("cfg")).count()
    total = li.agg(F.count(F.lit(1)).alias("total"))
    every = spark.range(16).select(F.col("id").alias("cfg"))
    return every.join(counts, "cfg", "left").crossJoin(F.broadcast(total)).select("cfg", (F.coalesce("count", F.lit(0)) / F.col("total")).alias("p"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chain_id, k, log_target, log_proposal)."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 10).alias("chain_id"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1e5).alias("log_target"), F.lit(0.0).alias("log_proposal"))


def leaf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, v, n, chunks): leaves in the order of their sequences as text, then of their numbers."""
    h = haplotypes(spark, sf_dir).withColumn("text", bits.to_string(F.col("chunks"), F.col("n")))
    return ranked(h, ["text", "v"], "pos").select(F.col("pos").cast("int").alias("pos"), "v", "n", "chunks")


def _tree(spark: SparkSession, order: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    n = order.count()
    # places 1 .. n are leaves in order, those above are inner vertices; places 2k - 1 and 2k are the children of n + k
    down = F.sequence(F.lit(0), F.lit(n.bit_length()))
    lowest = F.aggregate(down, F.col("id"), lambda at, _: F.when(at > n, 2 * (at - n) - 1).otherwise(at))
    ids = spark.range(1, max(2, 2 * n - 1)).where(F.lit(n > 1)).select("id", lowest.cast("int").alias("pos"))
    up = ids.join(order.select("pos", "v", "n", "chunks"), "pos")
    k = F.floor((F.col("id") + 1) / 2)
    left = up.where("id % 2 = 1").select(k.alias("k"), F.col("chunks").alias("a"))
    right = up.where("id % 2 = 0").select(k.alias("k"), F.col("chunks").alias("b"))
    steps = left.join(right, "k").select("k", (1 + bits.hamming(F.col("a"), F.col("b"))).cast("long").alias("step"))
    inner = running(steps, "k", "step", "latitude").select((F.lit(n) + F.col("k")).cast("int").alias("v"), F.lit("coal").alias("kind"), F.col("latitude").cast("double").alias("latitude"))
    vertices = order.select("v", F.lit("leaf").alias("kind"), F.lit(0.0).alias("latitude")).unionByName(inner)
    edges = up.select((F.lit(n) + k).cast("int").alias("src"), F.when(F.col("id") <= n, F.col("v")).otherwise(F.col("id")).cast("int").alias("dst"))
    return vertices, arg_from_tree(edges), n


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(vertices, edges, n): a tree that joins neighbours in the order of their sequences, level by level. A vertex stands
    above the one before it by one more than the markers at which its children's first leaves differ."""
    return _tree(spark, leaf_order(spark, sf_dir))


def _events(spark: SparkSession, order: DataFrame, n: int) -> DataFrame:
    """(ridx, a, b, rvertex, cvertex, breakpoint, left_parent, right_parent, pb): independent recombinations of the leaves
    at places 8r - 7 and 8r - 5, right of one of the markers at which they differ."""
    end = lambda place, v, c: order.where(F.col("pos") % 8 == place).select(F.ceil(F.col("pos") / 8).cast("int").alias("ridx"), F.col("v").alias(v), F.col("n").alias("len"), F.col("chunks").alias(c))
    r = F.col("ridx")
    met = end(1, "a", "ca").join(end(3, "b", "cb").drop("len"), "ridx").where(r <= n // 8)
    flags = bits.unpack(bits.xor_(F.col("ca"), F.col("cb")), F.col("len"))
    met = met.withColumn("d", F.filter(F.transform(flags, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull()))
    at = F.when(F.size("d") == 0, 1).otherwise(F.least(F.get("d", F.pmod(r, F.greatest(F.size("d"), F.lit(1)))), F.col("len") - 1))
    rv = 2 * n + 2 * (r - 1)
    return met.select("ridx", "a", "b", rv.alias("rvertex"), (rv + 1).alias("cvertex"), (at + 0.5).alias("breakpoint"), (F.lit(n) + 4 * r - 3).alias("left_parent"), (rv + 1).alias("right_parent"), (F.lit(n) + 4 * r - 2).alias("pb"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(vertices, edges, events, n): the tree with its events applied."""
    order = materialize(leaf_order(spark, sf_dir), "leaves")
    vertices, edges, n = _tree(spark, order)
    vertices = materialize(vertices, "vertices")  # queries use these tables several times
    ev = materialize(_events(spark, order, n), "events")
    gone = ev.select(F.explode(F.array("a", "b")).alias("dst"))
    inf = F.lit(float("inf"))
    e = lambda s, d, lo, hi: F.struct(s.alias("src"), d.alias("dst"), lo.alias("lo"), hi.alias("hi"))
    c, zero = F.col, F.lit(0.0)
    new = ev.select(F.explode(F.array(e(c("rvertex"), c("a"), zero, inf), e(c("left_parent"), c("rvertex"), zero, c("breakpoint")), e(c("cvertex"), c("rvertex"), c("breakpoint"), inf), e(c("cvertex"), c("b"), zero, inf), e(c("pb"), c("cvertex"), zero, inf))).alias("e")).select("e.*")
    lat = vertices.select("v", "latitude")
    m = ev.join(lat.withColumnRenamed("latitude", "la"), F.col("left_parent") == F.col("v")).drop("v").join(lat.withColumnRenamed("latitude", "lb"), F.col("pb") == F.col("v")).withColumn("m", F.least("la", "lb"))
    added = m.select(F.explode(F.array(F.struct(c("rvertex").alias("v"), F.lit("rec").alias("kind"), (0.25 * c("m")).alias("latitude")), F.struct(c("cvertex").alias("v"), F.lit("coal").alias("kind"), (0.5 * c("m")).alias("latitude")))).alias("x")).select("x.*")
    edges = edges.join(gone, "dst", "left_anti").select("src", "dst", "lo", "hi").unionByName(new)
    return materialize(vertices.unionByName(added), "vertices"), materialize(edges, "edges"), ev, n
