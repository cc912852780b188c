import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from lineal.functions import bits
from lineal.operators import graph as g
from lineal.operators import intervals as iv
from lineal.operators import mutations as mu
from lineal.operators import sample as sm
from lineal.operators import sampling as sp
from lineal.operators import sequences as sq
from lineal.operators import storage as st
from lineal.operators import tables as tb
from lineal.operators import traversal as tr
from lineal.operators import validation as va
from lineal.sources import vcf


def test_bit_functions_at_all_lengths(spark):
    rng = random.Random(5)
    texts = ["", "0", "1", "01" * 32, "1" * 64, "1" * 65, *("".join(rng.choice("01") for _ in range(n)) for n in (63, 64, 65, 127, 128, 129, 200))]
    df = spark.createDataFrame([(i, t, "".join(rng.choice("01") for _ in t)) for i, t in enumerate(texts)], "v int, s string, t string")
    df = df.select("v", "s", "t", F.length("s").alias("n"), bits.parse(F.col("s")).alias("a"), bits.parse(F.col("t")).alias("b"))
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    show = lambda c: bits.to_string(c, n)
    shifts = (1, 5, 63, 64, 70, -1, -5, -63, -64, -70)
    out = df.select("s", "t", show(a).alias("same"), show(bits.not_(a, n)).alias("inv"), show(bits.xor_(a, b)).alias("xor"), bits.popcount(a).alias("pop"), bits.hamming(a, b).alias("ham"), show(bits.mask_range(n, F.lit(3), F.lit(66))).alias("mask"), *(show(bits.shift(a, n, k)).alias(f"k{i}") for i, k in enumerate(shifts)))
    for r in out.collect():
        s, t, m = r.s, r.t, len(r.s)
        assert r.same == s and r.inv == "".join("10"[int(c)] for c in s)
        assert r["xor"] == "".join("01"[x != y] for x, y in zip(s, t)) and r["pop"] == s.count("1") and r.ham == sum(x != y for x, y in zip(s, t))
        assert r.mask == "".join("1" if 3 <= i + 1 <= 66 else "0" for i in range(m))
        for i, k in enumerate(shifts):
            want = ("0" * k + s)[:m] if k > 0 else (s[-k:] + "0" * -k)[:m] if -k < m else "0" * m
            assert r[f"k{i}"] == want, (s, k)


def test_packing_round_trip(spark):
    rng = random.Random(1)
    rows = [(v, i + 1, rng.random() < 0.5) for v in range(3) for i in range(130)]
    df = spark.createDataFrame(rows, "v int, idx int, derived boolean")
    assert sorted(map(tuple, sq.long_form(sq.packed_form(df)).collect())) == sorted(rows)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_distance_matrix_blocks(spark, block):
    df = spark.createDataFrame([(1, 4, [0b0101]), (2, 4, [0b0110]), (3, 4, [0b1111])], "v int, n int, chunks array<long>")
    got = {(r.i, r.j): r.d for r in sq.distance_matrix(df, block=block).collect()}
    assert got == {(1, 1): 0, (2, 2): 0, (3, 3): 0, (1, 2): 2, (2, 1): 2, (1, 3): 2, (3, 1): 2, (2, 3): 2, (3, 2): 2}


def _sets(spark, rows):
    return spark.createDataFrame([(1, float(a), float(b)) for a, b in rows], "o int, lo double, hi double")


def _got(df):
    return sorted((r.lo, r.hi) for r in df.collect())


def test_intervals_by_hand(spark):
    inf = math.inf
    a = _sets(spark, [(0, 1), (1, 2), (1, 1), (5, 7), (6, 9), (20, inf)])
    assert _got(iv.simplify(a, ["o"])) == [(0, 2), (5, 9), (20, inf)]
    b = _sets(spark, [(1, 6), (8, 30)])
    assert _got(iv.intersect(a, b, ["o"])) == [(1, 2), (5, 6), (8, 9), (20, 30)]
    assert _got(iv.union(a, b, ["o"])) == [(0, inf)]
    assert iv.subset(_sets(spark, [(5, 6), (21, 22)]), a, ["o"]).first().subset is True
    assert iv.subset(_sets(spark, [(5, 6), (9, 10)]), a, ["o"]).first().subset is False
    assert iv.sets_disjoint(_sets(spark, [(2, 5)]), a, ["o"]).first().disjoint is True
    pts = spark.createDataFrame([(1, x) for x in (0.0, 2.0, 5.0, 9.0, 1e9)], "o int, x double")
    assert {r.x: r.inside for r in iv.contains_points(a, pts, ["o"]).collect()} == {0.0: True, 2.0: False, 5.0: True, 9.0: False, 1e9: True}
    assert iv.simplify(a.limit(0), ["o"]).count() == 0


def test_recombination_and_conversion_on_four_leaves(spark):
    inf = math.inf
    edges = spark.createDataFrame([(5, 1, 0.0, inf), (5, 2, 0.0, inf), (6, 3, 0.0, inf), (6, 4, 0.0, inf), (7, 5, 0.0, inf), (7, 6, 0.0, inf)], "src int, dst int, lo double, hi double")
    out = g.recombine(edges, (5, 1), (6, 3), 8, 2.5)
    rows = {(r.src, r.dst): (r.lo, r.hi) for r in out.collect()}
    assert rows[(8, 1)] == (0, inf) and rows[(5, 8)] == (0, 2.5) and rows[(9, 8)] == (2.5, inf) and rows[(9, 3)] == (0, inf) and rows[(6, 9)] == (0, inf) and len(rows) == 9
    more = {(r.src, r.dst): (r.lo, r.hi) for r in g.convert(out, (9, 8), 5, 1.0).collect()}
    assert more[(9, 8)] == (1.0, inf) and more[(5, 8)] == (0, 1.0)


def test_gumbel_max_distribution(spark):
    df = spark.range(4000).select(F.col("id").alias("grp"), F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.lit(x).alias("x")) for i, x in enumerate((0.0, math.log(2.0), math.log(5.0)))))).alias("e")).select("grp", "e.item", "e.x")
    got = {r.item: r["count"] / 4000 for r in sp.gumbel_max(df, ["grp"], "item", "x").groupBy("item").count().collect()}
    assert abs(got[0] - 1 / 8) < 0.03 and abs(got[1] - 2 / 8) < 0.03 and abs(got[2] - 5 / 8) < 0.03
    none = spark.createDataFrame([(1, 1, None), (1, 2, float("-inf"))], "grp int, item int, x double")
    assert abs(sp.gumbel_max(none, ["grp"], "item", "x").first().log_p + math.log(2)) < 1e-12


def test_vcf_round_trip(spark):
    rows = [(h, 10.0 * p, (h + p) % 3 == 0) for h in range(5) for p in range(1, 4)]
    path = vcf.write(spark.createDataFrame(rows, "haplotype int, position double, derived boolean"))
    # the fifth haplotype has no partner and is left out
    assert sorted(map(tuple, vcf.read(spark, path).collect())) == sorted(r for r in rows if r[0] < 4)


def _genealogy(spark):
    """Four leaves, a recombination above leaf 1 whose right side joins the edge above leaf 3."""
    inf = math.inf
    edges = [(8, 1, 0.0, inf), (5, 8, 0.0, 2.5), (9, 8, 2.5, inf), (5, 2, 0.0, inf), (9, 3, 0.0, inf), (6, 9, 0.0, inf), (6, 4, 0.0, inf), (7, 5, 0.0, inf), (7, 6, 0.0, inf)]
    vertices = [(v, "leaf", 0.0) for v in (1, 2, 3, 4)] + [(5, "coal", 4.0), (6, "coal", 5.0), (7, "coal", 9.0), (8, "rec", 1.0), (9, "coal", 2.0)]
    return spark.createDataFrame(vertices, "v int, kind string, latitude double"), spark.createDataFrame(edges, "src int, dst int, lo double, hi double")


def _pairs_of(df):
    return sorted((r.src, r.dst) for r in df.select("src", "dst").collect())


def test_walks_on_four_leaves(spark):
    v, e = _genealogy(spark)
    k = tr.with_kinds(e, v)
    left, right = g.covers(1.0), g.covers(3.0)
    assert _pairs_of(tr.edges_down(k, 7, left)) == [(5, 2), (5, 8), (6, 4), (6, 9), (7, 5), (7, 6), (8, 1), (9, 3)]
    # nothing below 5 but leaf 2 right of the breakpoint
    assert _pairs_of(tr.edges_down(k, 5, right)) == [(5, 2)]
    # the edge below a recombination is taken whatever the places
    cut = k.withColumn("hi", F.when(F.col("src") == 8, 0.5).otherwise(F.col("hi")))
    assert (8, 1) in _pairs_of(tr.edges_down(cut, 7, right))
    assert _pairs_of(tr.edges_down(k, 7, right, F.col("src_lat") >= 5.0)) == [(6, 4), (6, 9), (7, 5), (7, 6)]
    assert _pairs_of(tr.edges_up(k, spark.createDataFrame([(1,)], "v int"), right)) == [(6, 9), (7, 6), (8, 1), (9, 8)]
    assert _pairs_of(tr.edges_up(k, spark.createDataFrame([(99,)], "v int"), right)) == []
    sides = tr.with_sides(k, spark.createDataFrame([(8, 5, 2.5)], "rvertex int, left_parent int, breakpoint double"))
    assert {(r.src, r.dst): (r.side_lo, r.side_hi) for r in sides.where("dst = 8").collect()} == {(5, 8): (0.0, 2.5), (9, 8): (2.5, math.inf)}


def test_common_ancestors_over_places(spark):
    v, e = _genealogy(spark)
    sets = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 4)], "set_id int, v int")
    told = lambda places: {r.set_id: r.mrca for r in tr.lowest_common(e.where(places), sets, 7).collect()}
    assert told(g.covers(1.0)) == {1: 5, 2: 7, 3: 4} and told(g.covers(3.0)) == {1: 7, 2: 9, 3: 4}
    assert told(g.meets(2.0, 3.0)) == {1: 5, 2: 9, 3: 4}
    assert {(r.anc, r.v) for r in tr.ancestors_in(e.where(g.covers(3.0)), spark.createDataFrame([(1,)], "v int"), []).collect()} == {(8, 1), (9, 1), (6, 1), (7, 1)}
    grid = spark.createDataFrame([(0.0,), (2.5,), (7.0,)], "x double")
    closure = g.closure(e, v.where("kind = 'leaf'").select("v"))
    assert {r.x: r.tmrca for r in g.root_times(closure, 4, grid, v).collect()} == {0.0: 9.0, 2.5: 9.0, 7.0: 9.0}


def test_descents(spark):
    v, e = _genealogy(spark)
    at3 = e.where(g.covers(3.0)).select("src", "dst")
    states = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, True), (9, True)], "v int, derived boolean")
    got = {(r.src, r.dst): r.rlat for r in tr.lowest_start(at3, states, v).collect()}
    assert got[(9, 8)] == 0.0 and got[(7, 5)] == 0.0 and got[(7, 6)] == 5.0 and got[(6, 9)] == 2.0
    changed = states.withColumn("derived", F.when(F.col("v") == 8, False).otherwise(F.col("derived")))
    assert {(r.src, r.dst): r.rlat for r in tr.lowest_start(at3, changed, v).collect()}[(9, 8)] == 1.0
    asked = spark.createDataFrame([(1, 7, 6, 3.0), (2, 7, 6, 6.0), (3, 7, 6, 0.5)], "id int, src int, dst int, at double")
    assert {r.id: (r.src, r.dst) for r in tr.edge_at(at3, asked, v).collect()} == {1: (6, 4), 2: (7, 6), 3: (6, 4)}


def test_planted_violations(spark):
    v, e = _genealogy(spark)
    hap = spark.createDataFrame([(i, 3, [b]) for i, b in ((1, 0b101), (2, 0b001), (3, 0b110), (4, 0b010))], "v int, n int, chunks array<long>")
    markers = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3)], "idx int, position double")

    def count(v, e, hap=hap, spoil=None):
        seqs = mu.vertex_sequences(g.closure(_genealogy(spark)[1], hap.select("v")), hap, markers)
        seqs = seqs if spoil is None else seqs.withColumn("bits", F.when(F.col("v") == spoil, F.col("bits") + 1).otherwise(F.col("bits")))
        muts = mu.mutation_edges(mu.edge_differences(e, seqs, markers))
        return {r.rule: r.violations for r in va.graph_violations(v, e, seqs, muts, hap, markers).collect() if r.violations}

    base = count(v, e)
    assert set(base) <= {"one mutation per marker"}
    low = v.withColumn("latitude", F.when(F.col("v") == 9, 99.0).otherwise(F.col("latitude")))
    assert count(low, e)["children lie below parents"] == 1
    assert count(v, e.where("dst <> 4"))["leaves have a parent alone"] == 1 and count(v, e.where("dst <> 4"))["coalescences have two children and a parent, if any"] == 1
    short = e.withColumn("hi", F.when(F.col("dst") == 9, 2.0).otherwise(F.col("hi")))
    assert count(v, short)["parental intervals are unions of child intervals"] == 2
    assert count(v, e.withColumn("hi", F.when(F.col("dst") == 4, 2.0).otherwise(F.col("hi"))))["leaves carry all places"] == 1
    assert count(v, e.where("not (src = 9 and dst = 8)"))["recombinations have a child and two parents"] == 1
    assert count(v, e, spoil=6)["states are those that all children have"] >= 1 and count(v, e, spoil=1)["leaf sequences are those of the sample"] == 1
    tree = spark.createDataFrame([(5, 1), (5, 2), (6, 3), (6, 4), (7, 5), (7, 6)], "src int, dst int")
    tv = v.where("v <= 7")
    bad = lambda v, e: {r.rule: r.violations for r in va.tree_violations(v, e).collect() if r.violations}
    assert bad(tv, tree) == {}
    assert "latitudes rise with vertex numbers" in bad(tv.withColumn("latitude", F.when(F.col("v") == 6, 3.0).otherwise(F.col("latitude"))), tree)
    assert "one root" in bad(tv, tree.where("dst <> 5")) and "leaves have a parent alone" in bad(tv, tree.where("dst <> 1"))
    assert bad(tv, tree.unionByName(spark.createDataFrame([(5, 6)], "src int, dst int")))["children have smaller numbers"] == 1


def test_hot_owner_intervals_and_points(spark):
    """One owner with most rows, over many ranges; islands and points as by hand."""
    rng = random.Random(8)
    rows = [(1, float(lo), float(lo + rng.choice([1, 2, 3, 40]))) for lo in (rng.randrange(6000) for _ in range(1500))] + [(None, 1.0, 2.0), (2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "o int, lo double, hi double").repartition(5)
    want, top = [], None
    for lo, hi in sorted((a, b) for o, a, b in rows if o == 1):
        if top is None or lo > top:
            want.append([lo, hi])
        top = want[-1][1] = max(want[-1][1], hi)
    got = iv.simplify(df, ["o"]).collect()
    assert sorted([r.lo, r.hi] for r in got if r.o == 1) == want and [(r.lo, r.hi) for r in got if r.o is None] == [(1.0, 2.0)]
    points = spark.createDataFrame([(1, x / 2) for x in range(0, 12_200, 7)] + [(3, 1.0)], "o int, x double")
    inside = {(r.o, r.x): r.inside for r in iv.contains_points(df, points, ["o"]).collect()}
    assert all(v == (o == 1 and any(a <= x < b for a, b in want)) for (o, x), v in inside.items()) and len(inside) == points.count()


def test_positions_to_markers_over_ranges(spark):
    marks = sorted({random.Random(i).randrange(10_000) / 10 for i in range(400)})
    m = spark.createDataFrame([(i + 1, x) for i, x in enumerate(marks)], "idx int, position double")
    asked = spark.createDataFrame([(i, i / 7) for i in range(7200)], "id int, pos double").repartition(6)
    got = {r.id: r.idx for r in sm.pos_to_idx(asked, m, ["id"]).collect()}
    assert got == {i: min(bisect.bisect_left(marks, i / 7) + 1, len(marks)) for i in range(7200)}


def test_ranks_and_chains(spark):
    df = spark.createDataFrame([(x * 7919 % 1000, x) for x in range(1000)], "a long, _part long").repartition(7)
    assert {r.a: r.k for r in st.ranked(df, ["a"], "k").collect()} == {i: i + 1 for i in range(1000)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "v int, to int")
    assert {r.v: r.to for r in st.followed(chain, [], "v", "to").collect()} == {**{i: 300 for i in range(300)}, 1000: 1001}
    assert st.unused(["A", "a_"], "a", "b") == ["a__", "b"]


def test_nearest_by_blocks(spark):
    rng = random.Random(4)
    rows = [(v, 70, [rng.getrandbits(64) - (1 << 63), rng.getrandbits(6)]) for v in range(1, 41)] + [(99, 70, [0, 0])]
    got = {r.v: (r.nearest, r.d) for r in sq.nearest(spark.createDataFrame(rows, "v int, n int, chunks array<long>"), block=7).collect()}
    d = lambda a, b: sum(((x ^ y) % (1 << 64)).bit_count() for x, y in zip(a, b))
    for v, _, c in rows:
        dist, w = min((d(c, x), w) for w, _, x in rows if w != v)
        assert got[v] == (w, dist)
    assert sq.nearest(spark.createDataFrame(rows[:1], "v int, n int, chunks array<long>")).count() == 0


def test_provenance_takes_the_last_value(spark):
    rec = spark.createDataFrame([(1, '{"parameters": {"rate": 1e-8, "population_size": 100}}'), (2, '{"parameters": {"rate": 2e-8}}')], "id int, record string")
    r = tb.provenance(rec).first()
    assert (r.rate, r.population_size, r.recombination_rate) == (2e-8, 100.0, None)
