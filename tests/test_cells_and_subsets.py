"""Overlap joins over unlike widths, and distributions of many coordinates, against brute force."""

import math
import random

from pyspark.sql import functions as F

from lineal.operators import bernoulli as bm
from lineal.operators import intervals as iv
from lineal.operators import sample as sm


def _rows(rng, n):
    out = []
    for i in range(n):
        lo = rng.choice([0.0, -3.0, rng.uniform(-1e6, 1e6), float(rng.randrange(64)), 1e9, 2.0**40])
        hi = rng.choice([lo, lo + 1, lo + 2.0 ** rng.randrange(-20, 30), math.inf, lo + 1e-9, lo - 1, 1e16])
        out.append((i % 2, i, lo, hi))
    return out + [(0, n, None, 1.0), (1, n + 1, 1.0, None), (None, n + 2, 0.0, 9.0)]


def test_overlaps_of_all_widths(spark):
    rng = random.Random(11)
    a, b = _rows(rng, 220), _rows(rng, 180)
    one = spark.createDataFrame(a, "o int, i int, lo double, hi double").withColumn("_cell", F.lit(1))
    two = spark.createDataFrame(b, "o int, j int, lo2 double, hi2 double")
    got = sorted((r.i, r.j) for r in iv.overlaps(one, two, ["o"]).collect())
    full = lambda r: r[0] is not None and r[2] is not None and r[3] is not None and r[2] < r[3]
    want = sorted((x[1], y[1]) for x in a if full(x) for y in b if full(y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 1000
    assert iv.overlaps(one.limit(0), two, ["o"]).count() == 0 == iv.overlaps(one.limit(0), two.limit(0), ["o"]).count()
    zero = spark.createDataFrame([(1, 0.0, math.inf)], "o int, lo double, hi double")
    assert iv.overlaps(zero, zero.withColumnsRenamed({"lo": "lo2", "hi": "hi2"}), ["o"]).count() == 1


def test_an_endless_row_makes_few_cells(spark):
    short = spark.range(2000).select(F.lit(1).alias("o"), (F.col("id") * 500.0).alias("lo2"), (F.col("id") * 500.0 + 1).alias("hi2"))
    endless = spark.createDataFrame([(1, 0.0, math.inf)], "o int, lo double, hi double")
    cells = iv.Cells(endless, short)
    assert cells.cut(endless, "lo", "hi", cells.homes[1], "k", "c", "h").count() < 100
    assert cells.cut(short, "lo2", "hi2", cells.homes[0], "k", "c", "h").count() <= 2000 * 6
    assert iv.overlaps(endless, short, ["o"]).count() == 2000


def test_markers_in_ranges_of_all_widths(spark):
    rng = random.Random(12)
    marks = [(i + 1, x) for i, x in enumerate(sorted({rng.choice([rng.uniform(0, 1e6), float(rng.randrange(40))]) for _ in range(300)}))]
    ranges = [(i, *((lo := rng.choice([-5.0, rng.uniform(0, 1e6), float(rng.randrange(40))])), rng.choice([lo, lo + 1, lo + 1000, 2e6, math.inf]))) for i in range(120)]
    got = sorted((r["_cell"], r.idx) for r in sm.markers_in(spark.createDataFrame(ranges, "_cell int, lo double, hi double"), spark.createDataFrame(marks, "idx int, position double"), ["_cell"]).collect())
    assert got == sorted((i, m) for i, lo, hi in ranges for m, x in marks if lo <= x < hi)


def test_subset_sums_of_sixteen_coordinates(spark):
    n = 16
    rng = random.Random(13)
    p = [rng.random() if rng.random() < 0.9 else 0.0 for _ in range(1 << n)]
    total = sum(p)
    p = [x / total for x in p]
    d = spark.createDataFrame(list(enumerate(p)), "cfg long, p double")
    sums = p[:]
    for k in range(n):
        for c in range(1 << n):
            if not c >> k & 1:
                sums[c] += sums[c | 1 << k]
    got = {r.mask: r.p for r in bm.prob_all_one(d, bm.subsets(n, d), n).collect()}
    assert len(got) == (1 << n) - 1 and all(abs(x - sums[m]) < 1e-9 for m, x in got.items())
    masks = [0, 1, 0b1010101010101010, 0b1111000000001111, (1 << n) - 1]
    want = {}
    for m in masks:
        for c, x in enumerate(p):
            want[m, c & m] = want.get((m, c & m), 0.0) + x
    told = {(r.mask, r.cfg): r.p for r in bm.marginal(d, spark.createDataFrame([(m,) for m in masks], "mask long"), n).collect()}
    assert set(told) == set(want) and all(abs(told[k] - want[k]) < 1e-9 for k in want)


def test_draws_by_ranges(spark):
    d = spark.createDataFrame([(0, 0.25), (1, 0.0), (2, 0.5), (7, 0.25)], "cfg long, p double")
    draws = spark.createDataFrame([(1, 0.0), (2, 0.2499), (3, 0.25), (4, 0.75), (5, 0.9999), (6, 1.0), (7, None)], "cfg_ int, u double")
    assert {r.cfg_: r.cfg for r in bm.draw(d, draws).collect()} == {1: 0, 2: 0, 3: 2, 4: 7, 5: 7, 6: 7, 7: None}
