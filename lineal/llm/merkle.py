"""Merkle manifests of tables: digests of rows in trees, proofs, and their verification by a recursive climb."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, offsets

#: Children of a node; hex digits of a digest.
WIDTH, DIGITS = 16, 64
#: Rows of a climb that meet one copy of a node, about.
MEET = 4_096
#: Name of the tree over all sources' trees. Those are called "-" (null source) or "=" and the source.
TOP = "^"
_ROWS = "spark.sql.cteRecursionRowLimit"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value as text that says where it ends: `-` if null, else its number of UTF-8 bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row of values."""
    return digest(*(framed(v) for v in values))


def _name(tree: Column | str, level: int, number: Column) -> Column:
    """A node's name; level and number hold no slash, so it is the node's alone whatever the tree is called."""
    return F.concat(tree, F.lit(f"/{level}/"), number.cast("string"))


def _lowest(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, hash, ..) with `number`, their place from 0 in the tree, and `n`, the tree's rows.

    Rows are dealt by ranges of (tree, order) and numbered within a range; ranges are offset by counts of one row per range and tree. No tree
    has to fit into a task."""
    dealt = materialize(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "leaves")
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    before = offsets(counts, ["tree"], "part", "c").join(counts.groupBy("tree").agg(F.sum("c").alias("n")), "tree")
    k = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    numbered = dealt.withColumn("k", k).join(before, ["tree", "part"])
    return numbered.withColumn("number", (F.col("off") + F.col("k")).cast("long")).drop("part", "k", "off")


def _levels(lowest: DataFrame) -> list[DataFrame]:
    """The levels above the lowest, each a table (tree, number, hash, n, below, children): the level's nodes in the tree, leaves below a node, and digests below it in a row.
    One aggregation a level, a sixteenth of the rows of the one before; a tree that has come to one node goes no further."""
    out, at = [], lowest
    while (at.agg(F.max("n")).first()[0] or 0) > 1:
        below = at.where("n > 1").groupBy("tree", F.floor(F.col("number") / WIDTH).alias("up"))
        row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "hash"))), lambda x: x.hash), "")
        made = below.agg(row.alias("children"), F.ceil(F.max("n") / WIDTH).alias("n"), F.sum("below").alias("below"))
        at = materialize(made.select("tree", F.col("up").alias("number"), F.sha2("children", 256).alias("hash"), "n", "below", "children"), "level")
        out.append(at)
    return out


def _linked(rows: DataFrame, level: int) -> DataFrame:
    """rows of a level with `up`, the name of the node above in the same tree (null: there is none), and `slot`, their place below it."""
    many = F.col("n") > 1
    return rows.withColumns({"up": F.when(many, _name(F.col("tree"), level + 1, F.floor(F.col("number") / WIDTH))), "slot": F.when(many, F.col("number") % WIDTH)})


def manifest(rows: DataFrame, key: str = "doc_id", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The trees of rows (key, source, leaf, claim), claim a digest to be verified in the leaf's place (null: the leaf): two tables.

    leaves: (key, leaf, claim, alone, up, slot), alone if the leaf is all of its source, so its subroot.
    nodes: (node, copies, children, hash, is_subroot, up, slot, up_copies), up the name of the node above, children the digests below in a row, copies
    how often a climb needs the node so that no more than MEET of its rows, or so, meet a copy.

    A source's leaves stand in order of their keys, null first, then of their digests; while more than one node is left, each WIDTH of them in a row
    become their digest. What is left is the subroot. Subroots, in order of their sources (null first, bytewise), go on in the same way to the root.
    Texts are hashed where they are read; only digests move. No source has to fit into a task. No rows: two empty tables.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    own = materialize(rows.select(tree.alias("tree"), F.col(key).alias("key"), F.col("leaf").alias("hash"), F.coalesce("claim", "leaf").alias("claim"), F.lit(1).cast("long").alias("below")), "digests")
    lowest = materialize(_lowest(own, ["key", "hash", "claim"]), "leaves")
    levels = _levels(lowest)
    tops = [t.where("n = 1").select("tree", "hash", "below") for t in (lowest, *levels)]
    sources = reduce(DataFrame.unionByName, tops).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "hash", "below")
    above = materialize(_lowest(sources, ["of"]), "subroots")
    over = _linked(above, 0).select(F.col("of").alias("tree"), F.col("up").alias("over"), F.col("slot").alias("place"))

    def crossed(linked: DataFrame) -> DataFrame:
        """Tops of sources' trees lead to the tree above: one row for each source here."""
        alone = linked.where("n = 1").join(over, "tree").withColumns({"up": F.col("over"), "slot": F.col("place")}).drop("over", "place")
        return linked.where("n > 1").unionByName(alone)

    def nodes_of(table: DataFrame, level: int, of_source: bool) -> DataFrame:
        linked = _linked(table, level).withColumn("is_subroot", (F.col("n") == 1) & F.lit(of_source))
        linked = crossed(linked) if of_source else linked
        return linked.select(_name(F.col("tree"), level, F.col("number")).alias("node"), F.ceil(F.col("below") / (WIDTH * MEET)).alias("copies"), "children", "hash", "is_subroot", "up", "slot")

    made = [nodes_of(t, i + 1, True) for i, t in enumerate(levels)] + [nodes_of(t, i + 1, False) for i, t in enumerate(_levels(above))]
    if not made:
        made = [rows.sparkSession.createDataFrame([], "node string, copies long, children string, hash string, is_subroot boolean, up string, slot long")]
    leaves = crossed(_linked(lowest, 0)).select("key", F.col("hash").alias("leaf"), "claim", (F.col("n") == 1).alias("alone"), "up", "slot")
    nodes = materialize(reduce(DataFrame.unionByName, made), "nodes")
    return leaves, nodes.join(nodes.select(F.col("node").alias("up"), F.col("copies").alias("up_copies")), "up", "left")


_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT up, copy, slot, seed, leaves, children, folds, above, subroot, root FROM {first}
  UNION ALL
  SELECT n.up, pmod(c.seed, n.up_copies), n.slot, c.seed, c.leaves, c.children,
         transform(c.folds, f -> sha2(concat(left(n.children, int(c.slot * 64)), f, substr(n.children, int(c.slot * 64 + 65))), 256)),
         concat(c.above, left(n.children, int(c.slot * 64)), substr(n.children, int(c.slot * 64 + 65))),
         CASE WHEN n.is_subroot THEN n.hash ELSE c.subroot END, n.hash
  FROM climb c JOIN {nodes} n ON n.node = c.up AND n.copy = c.copy
)
SELECT leaves, children, folds, above, subroot, root FROM climb WHERE up IS NULL
"""


def climbed(leaves: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of manifest()'s leaves.

    A recursive query goes up from each leaf over the stored nodes: at each it appends the siblings to the proof and folds the claimed digest with them.
    proof_sha256 is the digest of all siblings, from the lowest level to the root, left to right; folded_root what the claim comes to; verified whether
    it is the root. The leaves of one node, WIDTH at most, go up in one row, as all siblings above them are the same: a level moves a sixteenth of
    the leaves. All rows meet in the highest nodes, so nodes are met in copies, by a hash of where a row comes from. A table of one row has its leaf for a root and the digest of nothing for a proof. Rows that
    are alike are leaves each.
    """
    spark = leaves.sparkSession
    cut = lambda children, slot: (F.substring(children, F.lit(1), (slot * DIGITS).cast("int")), F.substring(children, (slot * DIGITS + DIGITS + 1).cast("int"), F.lit(WIDTH * DIGITS)))
    group = leaves.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.collect_list(F.struct("key", "leaf", "claim", "alone", "slot")).alias("leaves"))
    own = lambda x: cut(F.col("children"), x.slot)
    folds = F.transform("leaves", lambda x: digest(own(x)[0], x.claim, own(x)[1]))
    bare = F.transform("leaves", lambda x: F.struct(x.key.alias("key"), x.leaf.alias("leaf"), x.alone.alias("alone"), x.slot.alias("slot")))
    seed = F.xxhash64("node")
    first = group.join(nodes, "node").select("up", F.pmod(seed, F.col("up_copies")).alias("copy"), "slot", seed.alias("seed"), bare.alias("leaves"), "children", folds.alias("folds"), F.lit("").alias("above"), F.when(F.col("is_subroot"), F.col("hash")).alias("subroot"), F.col("hash").alias("root"))
    first = materialize(first, "lowest-nodes")
    met = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))

    limit = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, "-1")  # as many rows as there are nodes above leaves, times levels
    try:
        top = materialize(spark.sql(_CLIMB, first=first, nodes=met), "climbed")
    finally:
        spark.conf.set(_ROWS, limit)
    told = top.select(F.posexplode("leaves").alias("i", "x"), "children", "folds", "above", "subroot", "root").select("x.*", "children", F.get("folds", F.col("i")).alias("folded_root"), "above", "subroot", "root")
    left, right = cut(F.col("children"), F.col("slot"))
    told = told.select("key", "leaf", F.when(F.col("alone"), F.col("leaf")).otherwise(F.col("subroot")).alias("subroot"), "root", digest(left, right, F.col("above")).alias("proof_sha256"), "folded_root")
    lone = leaves.where("up is null").select("key", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.sha2(F.lit(""), 256).alias("proof_sha256"), F.col("claim").alias("folded_root"))
    both = told.unionByName(lone)
    return both.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
