"""Keys whose sets of places overlap the same stretches of edges are walked once."""

import math

from lineal.operators import traversal as tr


def test_keys_with_the_same_stretches_are_one_walk(spark):
    edges = [(5, 4, 0.0, math.inf, "coal"), (5, 3, 0.0, 10.5, "coal"), (4, 2, 10.5, math.inf, "coal"), (4, 1, 20.5, math.inf, "coal"), (3, 6, 40.5, 50.5, "rec")]
    left = [(k, 1 + k / 100, 2 + k / 70) for k in range(60)]
    middle = [(k, 11 + k / 100, 12 + k / 70) for k in range(100, 160)]
    both = [(k, 3.0, 3.5) for k in range(200, 260)] + [(k, 30 + k / 100, 33.0) for k in range(200, 260)]
    none = [(300, 5.0, 5.0), (None, 1.0, 2.0)]
    roots = [(k, 5) for k in {k for k, *_ in left + middle + both + none}] + [(0, 4), (400, 5)]
    df = spark.createDataFrame(edges, "src int, dst int, lo double, hi double, src_kind string")
    walked, members = tr.walks_down(df, spark.createDataFrame(roots, "k int, v int"), spark.createDataFrame(left + middle + both + none, "k int, lo double, hi double"), "k")
    of = {r.k: r._walk for r in members.collect()}
    rows = walked.collect()
    assert len(of) == 180 and len(set(of.values())) == 4 and len(rows) == len(set(rows)) == 3 + 3 + 2 + 5
    got = {k: {(r.src, r.dst) for r in rows if r._walk == w} for k, w in of.items()}
    first, second, third = {(5, 4), (5, 3), (3, 6)}, {(5, 4), (4, 2)}, {(5, 4), (5, 3), (4, 2), (4, 1), (3, 6)}
    assert all(got[k] == (first if k < 100 else second if k < 200 else third) for k in got)
