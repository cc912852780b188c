"""Tree-sequence tables: nodes, edges, sites, mutations; written as Parquet and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import closure
from .storage import fresh_path, ranked

#: Buckets that sites are dealt to when all leaves meet all sites.
BUCKETS = 64
NAMES = ("nodes", "edges", "sites", "mutations")


def nodes(vertices: DataFrame) -> DataFrame:
    return vertices.select((F.col("v") - 1).alias("id"), F.when(F.col("kind") == "leaf", 1).otherwise(0).alias("flags"), F.col("latitude").alias("time"))


def edges(edges_: DataFrame, length: float) -> DataFrame:
    return edges_.select(F.col("lo").alias("left"), F.least("hi", F.lit(length)).alias("right"), (F.col("src") - 1).alias("parent"), (F.col("dst") - 1).alias("child"))


def sites(markers: DataFrame) -> DataFrame:
    return markers.select((F.col("idx") - 1).alias("id"), "position", F.lit("0").alias("ancestral_state"))


def mutations(mutation_edges: DataFrame) -> DataFrame:
    return mutation_edges.select((F.col("idx") - 1).alias("site"), (F.col("dst") - 1).alias("node"), F.lit("1").alias("derived_state"))


def unbuilt_tree(haplotypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a tree that is not built yet: the sample's leaves, room for one inner vertex less, all at latitude 0, and
    no edge."""
    n = haplotypes.agg(F.count(F.lit(1)).alias("n"))
    inner = n.where("n > 1").select(F.explode(F.sequence(F.col("n") + 1, 2 * F.col("n") - 1)).alias("v"))
    vertices = haplotypes.select(F.col("v").cast("long").alias("v"), F.lit("leaf").alias("kind")).unionByName(inner.withColumn("kind", F.lit("coal")))
    edges_ = vertices.where(F.lit(False)).select(F.col("v").alias("src"), F.col("v").alias("dst"))
    return vertices.withColumn("latitude", F.lit(0.0)), edges_


def ordered_edges(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """edges with id, their place from 0 by the parent's time, parent, child and left end."""
    timed = edges_.join(nodes_.select(F.col("id").alias("parent"), "time"), "parent")
    return ranked(timed, ["time", "parent", "child", "left"], "id").withColumn("id", F.col("id") - 1).drop("time")


def indexed_edges(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """ordered_edges with the places from 0 at which they are put into and taken out of the tree, going from left to right: `insertion` by left
    end and the parent's time, parents upwards; `removal` by right end and time, parents downwards."""
    timed = ordered_edges(nodes_, edges_).join(nodes_.select(F.col("id").alias("parent"), "time"), "parent")
    put = ranked(timed, ["left", "time", "parent", "child", "id"], "insertion")
    down = [F.col("right"), *(F.col(c).desc() for c in ("time", "parent", "child", "id"))]
    taken = ranked(put, down, "removal")
    return taken.withColumns({"insertion": F.col("insertion") - 1, "removal": F.col("removal") - 1}).drop("time")


def write(nodes_: DataFrame, edges_: DataFrame, sites_: DataFrame, mutations_: DataFrame, path: str | None = None, provenance_: DataFrame | None = None) -> str:
    """The four tables, and records of provenance (id, record) if given, under path; edges ordered by the parent's time, parent, child and left end."""
    path = path or fresh_path(nodes_.sparkSession, "trees")
    timed = edges_.join(nodes_.select(F.col("id").alias("parent"), "time"), "parent").orderBy("time", "parent", "child", "left").select("left", "right", "parent", "child")
    for name, df in zip(NAMES, (nodes_, timed, sites_, mutations_), strict=True):
        df.write.parquet(f"{path}/{name}")
    if provenance_ is not None:
        provenance_.write.parquet(f"{path}/provenance")
    return path


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """(v, idx, derived) of the samples: derived where an odd number of mutations lies on the leaf's path at the site."""
    nodes_, edges_, sites_, muts = (spark.read.parquet(f"{path}/{name}") for name in NAMES)
    leaves = nodes_.where("flags = 1").select(F.col("id").alias("v"))
    up = closure(edges_.select(F.col("parent").alias("src"), F.col("child").alias("dst"), F.col("left").alias("lo"), F.col("right").alias("hi")), leaves)
    at = muts.join(sites_.select(F.col("id").alias("site"), "position"), "site")
    hit = up.join(at, F.col("anc") == F.col("node")).where("lo <= position and (position < hi or lvl = 0)").groupBy("v", "site").agg((F.count(F.lit(1)) % 2 == 1).alias("derived"))
    # all pairs of leaves and sites are the result; they meet in buckets of sites
    used = at.select("site").distinct().withColumn("b", F.pmod(F.col("site"), F.lit(BUCKETS)))
    every = leaves.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1)))).join(used, "b").drop("b")
    return every.join(hit, ["v", "site"], "left").select((F.col("v") + 1).alias("v"), (F.col("site") + 1).alias("idx"), F.coalesce("derived", F.lit(False)).alias("derived"))


def provenance(records: DataFrame, column: str = "record") -> DataFrame:
    """(rate, recombination_rate, population_size, sequence_length): the last value that any record gives, by id."""
    fields = ("rate", "recombination_rate", "population_size", "sequence_length")
    p = records.select("id", *(F.get_json_object(column, f"$.parameters.{f}").cast("double").alias(f) for f in fields))
    return p.agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col("id"))).alias(f) for f in fields))
