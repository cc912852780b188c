"""Recombinations, conversions and what they change upstream, against a graph that is made again as a whole."""

import random

import pytest
from pyspark.sql import functions as F

from lineal.operators import structure as st
from lineal.operators.validation import graph_violations

INF = float("inf")
MARKERS = 100


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def islands(rows):
    out = []
    for lo, hi in sorted(rows):
        if lo >= hi:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def meet(a, b):
    return islands([(max(x, l), min(y, h)) for x, y in a for l, h in b])


class Whole:
    """A graph of plain dictionaries: kind and latitude of vertices, masks of edges (None: all), haplotypes of leaves."""

    def __init__(self, n, rng):
        self.n, self.rng = n, rng
        self.kind, self.lat, self.mask = {v: "leaf" for v in range(1, n + 1)}, dict.fromkeys(range(1, n + 1), 0.0), {}
        self.hap = {v: [rng.random() < 0.5 for _ in range(MARKERS)] for v in range(1, n + 1)}
        live = list(range(1, n + 1))
        for v in range(n + 1, 2 * n):
            a, b = rng.sample(live, 2)
            live = [x for x in live if x not in (a, b)] + [v]
            self.kind[v], self.lat[v] = "coal", float(10 * (v - n))
            self.mask[v, a] = self.mask[v, b] = None

    def root(self):
        return next(v for v in self.kind if not any(d == v for _, d in self.mask))

    def split(self, s, d, x):
        """x on the edge from s to d; the mask stays above d."""
        self.mask[x, d] = self.mask.pop((s, d))
        self.mask[s, x] = None

    def recombine(self, redge, cedge, bp, rlat, clat, r, c):
        self.kind[r], self.kind[c], self.lat[r], self.lat[c] = "rec", "coal", rlat, clat
        self.split(*redge, r)
        self.mask[redge[0], r] = [(0.0, bp)]
        if cedge[0] is None:
            self.mask[c, cedge[1]] = None
        else:
            self.split(*cedge, c)
        self.mask[c, r] = [(bp, INF)]

    def convert(self, s, d, other, bp):
        self.mask[s, d] = islands([*self.mask[s, d], (bp, INF)])
        self.mask[other, d] = meet(self.mask[other, d], [(0.0, bp)])

    def made(self):
        """(edges, states): edge -> stretches, vertex -> {marker: derived}."""
        order, edges, states, carried = sorted(self.kind, key=lambda v: (self.lat[v], v)), {}, {}, {}
        down = lambda v: [d for s, d in self.mask if s == v]
        done = set()
        while len(done) < len(order):
            for v in order:
                if v in done or any(d not in done for d in down(v)):
                    continue
                if self.kind[v] == "leaf":
                    carried[v], states[v] = [(0.0, INF)], {i + 1: x for i, x in enumerate(self.hap[v])}
                else:
                    carried[v] = islands([x for d in down(v) for x in edges[v, d]])
                    states[v] = {}
                    for i in range(1, MARKERS + 1):
                        seen = [states[d][i] for d in down(v) if any(lo <= i < hi for lo, hi in edges[v, d]) and i in states[d]]
                        if seen:
                            states[v][i] = all(seen)
                for s, d in self.mask:
                    if d == v:
                        edges[s, d] = carried[v] if self.mask[s, d] is None else meet(carried[v], self.mask[s, d])
                done.add(v)
        return edges, states

    def graph(self, spark):
        edges, states = self.made()
        rows = [(s, d, lo, hi) for (s, d), own in edges.items() for lo, hi in own or [(0.0, 0.0)]]
        seqs = []
        for v, own in states.items():
            for chunk in range((MARKERS + 63) // 64):
                here = {i: x for i, x in own.items() if (i - 1) // 64 == chunk}
                if here:
                    seqs.append((v, chunk, signed(sum(1 << (i - 1) % 64 for i, x in here.items() if x)), signed(sum(1 << (i - 1) % 64 for i in here))))
        masks = [(d, s, lo, hi) for (s, d), own in self.mask.items() if own is not None for lo, hi in own]
        make = spark.createDataFrame
        return st.Graph(
            make([(v, k, self.lat[v]) for v, k in self.kind.items()], "v int, kind string, latitude double"),
            make(rows, "src int, dst int, lo double, hi double"),
            make(masks, "v int, src int, lo double, hi double"),
            make(seqs, "v int, chunk int, bits long, mask long"),
        )


def plain(g):
    edges = {tuple(r) for r in g.edges.select("src", "dst", "lo", "hi").collect()}
    return edges, {tuple(r) for r in g.sequences.select("v", "chunk", "bits", "mask").collect()}, {tuple(r) for r in g.vertices.select("v", "kind", "latitude").collect()}, {tuple(r) for r in g.masks.select("v", "src", "lo", "hi").collect()}


@pytest.fixture(scope="module")
def markers(spark):
    return spark.range(1, MARKERS + 1).selectExpr("cast(id as int) as idx", "cast(id as double) as position")


EVENT = "event int, rsrc int, rdst int, csrc int, cdst int, breakpoint double, rlat double, clat double"


def drawn(w, count, rng):
    """Events of which many name one edge, some each other's new edges, some no edge above the root; applied to w one by one, by latitude."""
    top, events, cuts = max(w.kind), [], {}
    lat = lambda v: w.lat[v]
    root, links, high = w.root(), [], w.lat[w.root()]
    edges = sorted(w.mask, key=lambda e: (lat(e[0]) - lat(e[1]), e))
    for k in range(count):
        r, c = top + 2 * k + 1, top + 2 * k + 2
        s, d = rng.choice(links) if links and rng.random() < 0.3 else rng.choice(edges[-6:])
        rlat = rng.uniform(lat(d), lat(s))
        above = [e for e in edges if lat(e[0]) > rlat and e != (s, d)]
        if rng.random() < 0.3 or not above:
            (cs, cd), clat = (None, root), max(high, rlat) + rng.uniform(1, 50)
        else:
            cs, cd = rng.choice(above)
            clat = rng.uniform(max(lat(cd), rlat), lat(cs))
        events.append((k + 1, s, d, cs, cd, rng.randint(1, MARKERS - 1) + 0.5, rlat, clat))
        w.lat[r], w.lat[c] = rlat, clat
        links.append((c, r))
        cuts.setdefault((s, d), []).append((rlat, r))
        cuts.setdefault((cs, cd), []).append((clat, c))
    return events, cuts


def apply_whole(w, events, cuts):
    top = min(x for own in cuts.values() for _, x in own) - 1
    for k, *_ in events:
        w.kind[top + 2 * k - 1], w.kind[top + 2 * k] = "rec", "coal"
    links = {(top + 2 * k, top + 2 * k - 1): e for e in events for k in [e[0]]}
    waiting = dict(cuts)
    for edge, e in links.items():
        w.mask[edge] = [(e[5], INF)]
    for edge in list(waiting):
        s, d = edge
        below = d
        for i, (_, x) in enumerate(sorted(waiting[edge])):
            w.mask[x, below] = (w.mask.pop(edge) if s is not None else None) if i == 0 else None
            below = x
        if s is not None:
            w.mask[s, below] = None
    for edge, e in links.items():
        r = edge[1]
        left = [(s, d) for s, d in w.mask if d == r and w.mask[s, d] is None]
        assert len(left) == 1
        w.mask[left[0]] = [(0.0, e[5])]


def test_batches_of_nested_and_root_recombinations(spark, markers):
    rng = random.Random(2)
    w = Whole(6, rng)
    g = w.graph(spark)
    events, cuts = drawn(w, 8, rng)
    assert any(e[3] is None for e in events) and any(e[1] > 11 for e in events) and len(cuts) < 16
    rng.shuffle(events)
    got, _ = st.recombine_all(g, spark.createDataFrame(events, EVENT), markers)
    apply_whole(w, sorted(events), cuts)
    assert plain(got) == plain(w.graph(spark))


def four(rng=None):
    """Leaves 1 to 4 under 5 (1, 2), 6 (3, 4) and 7."""
    w = Whole(4, rng or random.Random(0))
    w.mask = dict.fromkeys([(5, 1), (5, 2), (6, 3), (6, 4), (7, 5), (7, 6)])
    w.lat.update({5: 10.0, 6: 20.0, 7: 30.0})
    return w


def test_one_recombination_by_hand(spark, markers):
    w = four()
    got, seen = st.recombine_all(w.graph(spark), spark.createDataFrame([(1, 5, 1, 6, 3, 40.5, 2.0, 4.0)], EVENT), markers)
    edges = plain(got)[0]
    assert {(8, 1, 0.0, INF), (5, 8, 0.0, 40.5), (9, 8, 40.5, INF), (9, 3, 0.0, INF), (6, 9, 0.0, INF)} <= edges and not {(5, 1), (6, 3)} & {e[:2] for e in edges}
    assert {r.v for r in seen.collect()} == {5, 6, 7, 8, 9}
    w.recombine((5, 1), (6, 3), 40.5, 2.0, 4.0, 8, 9)
    assert plain(got) == plain(w.graph(spark))


def test_root_recoalescence_makes_a_new_root(spark, markers):
    w = four()
    got, _ = st.recombine_all(w.graph(spark), spark.createDataFrame([(1, 5, 1, None, 7, 40.5, 2.0, 44.0)], EVENT), markers)
    w.recombine((5, 1), (None, 7), 40.5, 2.0, 44.0, 8, 9)
    assert w.root() == 9 and plain(got) == plain(w.graph(spark))


def test_the_mask_goes_with_its_branch(spark, markers):
    """The edge above an older recombination vertex is cut by a vertex of a greater number than its other parent."""
    w = four()
    w.recombine((5, 1), (6, 3), 40.5, 2.0, 4.0, 8, 9)
    g = w.graph(spark)
    got, _ = st.recombine_all(g, spark.createDataFrame([(1, 5, 8, 6, 4, 70.5, 3.0, 15.0)], EVENT), markers)
    w.recombine((5, 8), (6, 4), 70.5, 3.0, 15.0, 10, 11)
    assert (8, 10, 0.0, 40.5) in plain(got)[3] and plain(got) == plain(w.graph(spark))


def test_events_that_name_no_edge_are_refused(spark, markers):
    g = four().graph(spark)
    with pytest.raises(ValueError, match="never exist"):
        st.recombine_all(g, spark.createDataFrame([(1, 5, 3, 6, 4, 70.5, 3.0, 15.0)], EVENT), markers)
    with pytest.raises(ValueError, match="latitudes"):
        st.recombine_all(g, spark.createDataFrame([(1, 5, 1, 6, 4, 70.5, 12.0, 15.0)], EVENT), markers)
    same, seen = st.recombine_all(g, spark.createDataFrame([], EVENT), markers)
    assert plain(same) == plain(g) and seen.count() == 0


def test_many_on_one_edge(spark, markers):
    """A hundred events on one edge, and a hundred roots."""
    w = four()
    g = w.graph(spark)
    events = [(k, 7, 5, None, 7, k / 2 + 0.5, 10 + k / 10, 100.0 - k / 10) for k in range(1, 101)]
    cuts = {(7, 5): [(e[6], 7 + 2 * e[0] - 1) for e in events], (None, 7): [(e[7], 7 + 2 * e[0]) for e in events]}
    for e in events:
        w.lat[7 + 2 * e[0] - 1], w.lat[7 + 2 * e[0]] = e[6], e[7]
    ev = st.numbered_events(spark.createDataFrame(events, EVENT), g.vertices)
    parents, lowest = st._cut(g.edges.select("src", "dst"), ev.selectExpr("rsrc as src", "rdst as dst", "rlat as lat", "rvertex as x").unionByName(ev.selectExpr("csrc as src", "cdst as dst", "clat as lat", "cvertex as x")))
    apply_whole(w, events, cuts)
    links = {(e[0] * 2 + 7, e[0] * 2 + 6) for e in events}
    assert {tuple(r) for r in parents.collect()} | links == set(w.mask) and {tuple(r) for r in lowest.collect()} == {(7, 5, 8), (0, 7, 207)}


def test_conversions_spread_upstream_and_stop(spark, markers):
    rng = random.Random(5)
    w = Whole(6, rng)
    events, cuts = drawn(w, 4, rng)
    apply_whole(w, events, cuts)
    g = w.graph(spark)
    recs = [v for v, k in w.kind.items() if k == "rec"]
    told = []
    for i, v in enumerate(recs[:4]):
        left, right = sorted(((s, d) for s, d in w.mask if d == v), key=lambda e: w.mask[e])
        bp = w.mask[left][0][1]
        one, two = (right, left) if i % 2 else (left, right)
        told.append((2 * i, one[0], v, two[0], bp / 2 if i % 2 else (bp + MARKERS) / 2))
        if i == 0:
            told.append((2 * i + 1, two[0], v, one[0], 90.0))  # a second one of the same vertex, the other way
    got, seen = st.convert_all(g, spark.createDataFrame(told, "event int, src int, dst int, other int, breakpoint double"), markers)
    for _, s, d, other, bp in told:
        w.convert(s, d, other, bp)
    assert plain(got) == plain(w.graph(spark))
    broken = graph_violations(got.vertices, got.edges, got.sequences, g.edges.selectExpr("1 as idx", "src", "dst").where("false"), got.sequences.where("v <= 6").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("chunk", "bits"))).alias("c")).selectExpr("v", "100 as n", "transform(c, x -> x.bits) as chunks"), markers).where("violations > 0").collect()
    assert [r.rule for r in broken] == ["one mutation per marker"]


def test_only_what_changes_is_looked_at(spark, markers):
    """States above all equal leaves stay the same, so nothing is passed on beyond the first vertex."""
    w = four()
    for v in w.hap:
        w.hap[v] = [False] * MARKERS
    g = w.graph(spark)
    again, seen = st.propagate(g, spark.createDataFrame([(5,), (1,)], "v int"), markers)
    assert plain(again) == plain(g) and [(r.v, r.changed) for r in seen.collect()] == [(5, False)]
    w.hap[1][3] = w.hap[2][3] = True
    new = st.Graph(g.vertices, g.edges, g.masks, w.graph(spark).sequences.where("v <= 4").unionByName(g.sequences.where("v > 4")))
    got, seen = st.propagate(new, spark.createDataFrame([(5,)], "v int"), markers)
    assert plain(got) == plain(w.graph(spark))
    assert {(r.v, r.round, r.changed) for r in seen.collect()} == {(5, 1, True), (7, 2, False)}
