"""An index of trees: depths, what stands below each vertex, preorder numbers and jump pointers.

Trees may be many, told apart by key columns (the marginal trees at some places, for instance). Everything is made by pointer
doubling, so a tree of height h takes about log2(h) rounds over one row per vertex, and no pair of vertex and ancestor is ever listed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import LEVELS
from .storage import materialize, ranked, running


class Forest:
    """Trees of edges (keys, src, dst), src the parent; `vertices` (keys, v), if given, may add vertices without edges.

    An edge that stands in several rows counts once. Keys must not be null. A vertex with two parents, and edges that close a
    circle, are refused.
    """

    def __init__(self, edges: DataFrame, keys: Sequence[str] = (), vertices: DataFrame | None = None):
        self.keys = [*keys]
        self.id = [*self.keys, "v"]
        up = materialize(edges.select(*self.keys, F.col("dst").alias("v"), F.col("src").alias("up")).distinct(), "forest")
        if not up.groupBy(*self.id).count().where("count > 1").isEmpty():
            raise ValueError("a vertex of a tree has two parents")
        inner = up.select(*self.keys, F.col("up").alias("v")).distinct().withColumn("_inner", F.lit(True))
        every = up.select(*self.id).unionByName(inner.select(*self.id))
        every = every if vertices is None else every.unionByName(vertices.select(*self.id))
        leaf = F.col("_inner").isNull()
        alone = F.when(leaf, F.col("v"))
        state = every.distinct().join(up, self.id, "left").join(inner, self.id, "left")
        state = state.select(*self.id, F.col("up").alias("anc"), F.col("up").isNotNull().cast("long").alias("depth"), F.lit(1).cast("long").alias("size"), leaf.cast("long").alias("n_leaves"), alone.alias("first_leaf"), alone.alias("last_leaf"))
        self.rounds = [materialize(state, "forest")]
        self._double()

    def _double(self) -> None:
        """Round k knows each vertex's ancestor 2^k above it, if any, and what stands less than 2^k below it. What stands that far
        below is what its vertex 2^k lower knows, so sums and extremes of a round add up to those of the next, combined map-side."""
        n = self.rounds[0].count()
        while True:
            now = self.rounds[-1]
            lifted = now.where("anc is not null")
            if lifted.isEmpty():
                return
            if 1 << (len(self.rounds) - 1) >= n:
                raise ValueError("edges of a tree close a circle")
            above = now.select(*self.keys, F.col("v").alias("anc"), F.col("anc").alias("_next"), F.col("depth").alias("_more"))
            below = lifted.groupBy(*self.keys, F.col("anc").alias("v")).agg(F.sum("size").alias("_size"), F.sum("n_leaves").alias("_leaves"), F.min("first_leaf").alias("_first"), F.max("last_leaf").alias("_last"))
            met = now.join(above, [*self.keys, "anc"], "left").join(below, self.id, "left")
            plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
            self.rounds.append(materialize(met.select(*self.id, F.col("_next").alias("anc"), plus("depth", "_more"), plus("size", "_size"), plus("n_leaves", "_leaves"), F.least("first_leaf", "_first").alias("first_leaf"), F.greatest("last_leaf", "_last").alias("last_leaf")), "forest"))

    @property
    def nodes(self) -> DataFrame:
        """(keys, v, depth, size, n_leaves, first_leaf, last_leaf): edges to the root, vertices and leaves at or below v, and the
        smallest and greatest of these leaves; a leaf is a vertex without children."""
        return self.rounds[-1].drop("anc")

    @cached_property
    def numbered(self) -> DataFrame:
        """nodes with (up, pre, last): the parent, the place in preorder from 1 (children by number) and the place of the last
        vertex below; a is v or above it where a.pre <= v.pre <= a.last.

        A vertex stands one place, and its smaller siblings' sizes, behind its parent; these sizes are summed over ranges of all vertices,
        not by parent, so a parent of most vertices is no task of its own. Sums up to the root are doubled like the ancestors.
        """
        own = self.nodes.join(self.rounds[0].select(*self.id, F.col("anc").alias("up")), self.id)
        placed = materialize(ranked(own.select(*self.id, "up", "size"), [*self.keys, "up", "v"], "place"), "forest")
        run = running(placed, "place", "size", "run").withColumn("run", F.col("run") - F.col("size"))
        run = materialize(run.select(*self.id, "up", "run"), "forest")
        begin = run.groupBy(*self.keys, "up").agg(F.min("run").alias("_begin"))
        family = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*self.keys, "up")]
        pre = run.alias("r").join(begin.alias("b"), family).select(*(F.col(f"r.{c}") for c in self.id), (F.col("run") - F.col("_begin") + 1).alias("pre"))
        for jumps in self.rounds[:-1]:
            above = pre.select(*self.keys, F.col("v").alias("anc"), F.col("pre").alias("_more"))
            met = pre.join(jumps.select(*self.id, "anc"), self.id).join(above, [*self.keys, "anc"], "left")
            pre = materialize(met.select(*self.id, (F.col("pre") + F.coalesce("_more", F.lit(0))).alias("pre")), "forest")
        return materialize(own.join(pre, self.id).withColumn("last", F.col("pre") + F.col("size") - 1), "forest")

    def lowest_above(self, sets: DataFrame) -> DataFrame:
        """(set_id, keys, mrca): in each tree that has all members of a set (set_id, v), the lowest vertex strictly above all of them,
        if there is one.

        The first and last member in preorder decide. From the first, the highest ancestor that is not above the last is found by jumps
        from long to short, one join each; its parent is the answer.
        """
        members = sets.select("set_id", "v").distinct()
        sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("_size"))
        here = members.join(self.numbered.select(*self.id, "pre"), "v")
        ends = here.groupBy("set_id", *self.keys).agg(F.count(F.lit(1)).alias("_here"), F.min_by("v", "pre").alias("v"), F.max("pre").alias("_to"))
        at = ends.join(sizes, "set_id").where(F.col("_here") == F.col("_size")).select("set_id", *self.id, "_to")
        spans = self.numbered.select(*self.keys, F.col("v").alias("anc"), F.col("pre").alias("_pre"), F.col("last").alias("_last"))
        for i, jumps in enumerate(reversed(self.rounds[:-1])):
            far = jumps.where("anc is not null").select(*self.id, "anc").join(spans, [*self.keys, "anc"])
            met = at.join(far, self.id, "left")
            off = (F.col("_to") < F.col("_pre")) | (F.col("_to") > F.col("_last"))
            at = met.select("set_id", *self.keys, F.when(off, F.col("anc")).otherwise(F.col("v")).alias("v"), "_to")
            at = materialize(at, "forest") if i % LEVELS == LEVELS - 1 else at
        return at.join(self.numbered.select(*self.id, "up"), self.id).where("up is not null").select("set_id", *self.keys, F.col("up").alias("mrca"))
