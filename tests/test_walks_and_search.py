"""Many walks at once, the early-ending marker search and the root's sweep against brute force."""

import math
import random
import shutil

from pyspark.sql import functions as F

from lineal.operators import graph as g
from lineal.operators import mutations as mu
from lineal.operators import storage as st
from lineal.operators import tables as tb
from lineal.operators import traversal as tr


def test_walks_of_many_keys(spark):
    rng = random.Random(21)
    kinds = {v: rng.choice(["coal", "coal", "rec"]) for v in range(1, 60)}
    edges = []
    for d in range(1, 59):
        lo = rng.choice([0.0, rng.uniform(0, 50)])
        edges.append((rng.randrange(d + 1, min(60, d + 8)), d, lo, rng.choice([math.inf, lo + rng.uniform(0, 40)]), None))
    edges = [(s, d, lo, hi, kinds[s]) for s, d, lo, hi, _ in edges]
    sets = [(k, (x := rng.uniform(0, 80)), x + rng.choice([0.0, 0.5, 3.0, 30.0])) for k in range(8) for _ in range(3)] + [(8, 0.0, math.inf), (None, 0.0, 5.0)]
    roots = {k: rng.choice([59, 58, 57, 50]) for k in range(10)}
    want = set()
    for k, root in roots.items():
        mine = [(lo, hi) for o, lo, hi in sets if o == k and lo < hi]
        here = [e for e in edges if any(e[2] < hi and lo < e[3] for lo, hi in mine)]
        level = {(s, d) for s, d, *_ in here if s == root}
        seen = set()
        while level:
            seen |= level
            level = {(s, d) for s, d, lo, hi, kind in edges for _, v in level if s == v and ((s, d, lo, hi, kind) in here or kind == "rec" and lo < hi)} - seen
        want |= {(k, *e) for e in seen}
    df = spark.createDataFrame(edges, "src int, dst int, lo double, hi double, src_kind string")
    got = tr.edges_down_each(df, spark.createDataFrame(list(roots.items()), "k int, v int"), spark.createDataFrame(sets, "k int, lo double, hi double"), "k").collect()
    assert {(r.k, r.src, r.dst) for r in got} == want and len(got) == len(want) > 50
    # one walk's edges are those of a walk on its own
    alone = tr.edges_down(df, roots[8], g.meets(0.0, math.inf)).select("src", "dst").distinct().collect()
    assert {(r.src, r.dst) for r in alone} == {(s, d) for k, s, d in want if k == 8}


def _sample(spark, n_markers, bad):
    """Two leaves under one vertex and a third beside; markers in `bad` mutate on two edges."""
    edges = spark.createDataFrame([(4, 1, 0.0, math.inf), (4, 2, 0.0, math.inf), (5, 4, 0.0, math.inf), (5, 3, 0.0, math.inf)], "src int, dst int, lo double, hi double")
    rows = []
    for v in range(1, 6):
        for chunk in range(-(-n_markers // 64)):
            x = sum(1 << (m - 1) % 64 for m in bad if (m - 1) // 64 == chunk) if v in (1, 3) else 0
            rows.append((v, chunk, x - (1 << 64) if x >> 63 else x))
    markers = spark.range(1, n_markers + 1).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("position"))
    return edges, spark.createDataFrame(rows, "v int, chunk int, bits long"), markers, spark.createDataFrame([], "rvertex int")


def test_next_inconsistent_from_many_starts(spark):
    bad = [3, 64, 65, 200, 450, 512]
    edges, seqs, markers, events = _sample(spark, 600, bad)
    starts = [1, 3, 4, 64, 65, 66, 201, 451, 512, 513, 600, 900, 1, None]
    got = mu.next_inconsistent_from(edges, seqs, markers, events, spark.createDataFrame([(s,) for s in starts], "start int")).collect()
    want = {(s, min(m for m in bad if m >= s), src, dst) for s in starts if s and s <= 512 for src, dst in ((4, 1), (5, 3))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    # an edge above a recombination vertex's child doesn't count
    rec = spark.createDataFrame([(4,)], "rvertex int")
    assert mu.next_inconsistent_from(edges, seqs, markers, rec, spark.createDataFrame([(1,)], "start int")).count() == 0
    assert mu.next_inconsistent_from(edges, seqs, markers, events, spark.createDataFrame([], "start int")).count() == 0
    assert mu.next_inconsistent_from(edges, seqs, markers.limit(0), events, spark.createDataFrame([(1,)], "start int")).count() == 0


def test_chunks_behind_the_answer_are_not_read(spark, tmp_path):
    edges, seqs, markers, events = _sample(spark, 640, [70, 600])
    path = str(tmp_path / "seqs")
    seqs.write.partitionBy("chunk").parquet(path)
    held = spark.read.schema("v int, bits long, chunk int").parquet(path)
    told = [tuple(r) for r in mu.next_inconsistent_from(edges, held, markers, events, spark.createDataFrame([(5,), (66,)], "start int")).collect()]
    for chunk in (3, 4, 5, 6, 7, 8, 9):
        shutil.rmtree(f"{path}/chunk={chunk}")
    again = [tuple(r) for r in mu.next_inconsistent_from(edges, held, markers, events, spark.createDataFrame([(5,), (66,)], "start int")).collect()]
    assert sorted(told) == sorted(again) == [(5, 70, 4, 1), (5, 70, 5, 3), (66, 70, 4, 1), (66, 70, 5, 3)]


def test_the_root_s_sweep_over_many_turns(spark):
    """Ten leaves whose way to the top goes by a lower vertex or past it, changing at each of 300 places."""
    n, places = 10, 300
    rows, want = [], {}
    for p in range(places):
        low = p % 3 != 0
        want[float(p)] = 5.0 if low else 9.0
        for v in range(1, n + 1):
            rows += [(101, v, float(p), float(p + 1), 2)] + ([(100, v, float(p), float(p + 1), 1)] if low or v > 1 else [])
    closure = spark.createDataFrame(rows, "anc int, v int, lo double, hi double, lvl int")
    vertices = spark.createDataFrame([(100, "coal", 5.0), (101, "coal", 9.0)], "v int, kind string, latitude double")
    got = {r.x: r.tmrca for r in g.root_times(closure, n, spark.createDataFrame([(x,) for x in want], "x double"), vertices).collect()}
    assert got == want


def test_orders_of_edges_in_and_out(spark):
    nodes = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 1.0), (3, 2.0)], "id int, time double")
    edges = spark.createDataFrame([(0.0, 5.0, 2, 0), (5.0, 9.0, 3, 0), (0.0, 9.0, 3, 1), (0.0, 5.0, 3, 2)], "left double, right double, parent int, child int")
    got = {(r.parent, r.child): (r.id, r.insertion, r.removal) for r in tb.indexed_edges(nodes, edges).collect()}
    assert got == {(2, 0): (0, 0, 1), (3, 0): (1, 3, 3), (3, 1): (2, 1, 2), (3, 2): (3, 2, 0)}
    assert st.unused(["a"], "a") == ["a_"]
