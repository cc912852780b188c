"""The index of trees against walks over the parents."""

import random

import pytest
from pyspark.sql import functions as F

from lineal.operators.forest import Forest


def _up(parent, v):
    out = []
    while v in parent:
        v = parent[v]
        out.append(v)
    return out


def _check(spark, trees, sets):
    """trees: {x: {child: parent}}."""
    rows = [(x, p, c) for x, parent in trees.items() for c, p in parent.items()]
    df = spark.createDataFrame(rows + rows[:3], "x int, src int, dst int").repartition(3)
    index = Forest(df, ["x"])
    got = {(r.x, r.v): r for r in index.numbered.collect()}
    want = {(x, v) for x, parent in trees.items() for v in {*parent, *parent.values()}}
    assert set(got) == want
    below = {k: [] for k in want}
    for x, v in want:
        for a in (v, *_up(trees[x], v)):
            below[x, a].append(v)
    for (x, v), r in got.items():
        leaves = [w for w in below[x, v] if w not in trees[x].values()]
        assert (r.depth, r.size, r.n_leaves, r.first_leaf, r.last_leaf, r.up) == (len(_up(trees[x], v)), len(below[x, v]), len(leaves), min(leaves), max(leaves), trees[x].get(v))
        assert sorted(got[x, w].pre for w in below[x, v]) == list(range(r.pre, r.last + 1))
    told = {(r.set_id, r.x): r.mrca for r in index.lowest_above(spark.createDataFrame([(i, v) for i, s in enumerate(sets) for v in s], "set_id int, v int")).collect()}
    for i, s in enumerate(sets):
        for x, parent in trees.items():
            common = [set(_up(parent, v)) for v in s] if all((x, v) in want for v in s) else [set()]
            common = set.intersection(*common)
            assert told.get((i, x)) == (max(common, key=lambda a: len(_up(parent, a))) if common else None), (s, x)


def test_random_trees_a_star_and_two_roots(spark):
    rng = random.Random(3)
    trees = {1: {c: rng.randrange(max(0, c - 6), c) for c in range(1, 120)}, 2: {c: 0 for c in range(1, 90)}, 3: {c: c - 2 for c in range(2, 70)}}
    sets = [rng.sample(range(125), rng.choice([1, 2, 2, 3, 5])) for _ in range(60)] + [[7, 7], [0], [0, 5]]
    _check(spark, trees, sets)


def test_a_chain_of_a_hundred_thousand(spark):
    """A closure of it would have five thousand million rows."""
    n = 100_000
    chain = spark.range(n).select(F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"))
    index = Forest(chain)
    assert index.nodes.where(F.col("depth") != F.col("v")).isEmpty() and index.nodes.where(F.col("size") + F.col("v") != n + 1).isEmpty()
    assert index.nodes.where("first_leaf <> 100000 or n_leaves <> 1").isEmpty() and index.nodes.count() == n + 1
    sets = spark.createDataFrame([(1, 99_999), (1, 5), (2, 70_000), (3, 1), (3, 100_000), (4, 0), (4, 9)], "set_id int, v int")
    assert {r.set_id: r.mrca for r in index.lowest_above(sets).collect()} == {1: 4, 2: 69_999, 3: 0}


def test_single_vertices_and_what_is_refused(spark):
    e = lambda rows: spark.createDataFrame(rows, "src int, dst int")
    alone = Forest(e([]), vertices=spark.createDataFrame([(4,), (9,)], "v int"))
    assert {(r.v, r.depth, r.n_leaves, r.pre) for r in alone.numbered.collect()} == {(4, 0, 1, 1), (9, 0, 1, 2)}
    assert alone.lowest_above(spark.createDataFrame([(1, 4)], "set_id int, v int")).count() == 0
    assert Forest(e([])).nodes.count() == 0
    with pytest.raises(ValueError, match="two parents"):
        Forest(e([(1, 2), (3, 2)]))
    with pytest.raises(ValueError, match="circle"):
        Forest(e([(1, 2), (2, 3), (3, 1)]))
