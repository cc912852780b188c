"""A chain of vertices above a root: the rounds that it takes are done by one task, and are those that tables would do."""

import random

from lineal.operators import structure as st
from test_structure import EVENT, Whole, four, plain, markers  # noqa: F401


def _chain(spark, n, markers):  # noqa: F811
    """n recombinations of leaves 1 and 3 of four(), each recoalescing above the root, above the one before."""
    told = [(k, *((5, 1) if k % 2 else (6, 3)), None, 7, 10.5 + 7 * k, 1.0 + k / 4, 40.0 + k) for k in range(1, n + 1)]
    return st.recombine_all(four(random.Random(5)).graph(spark), spark.createDataFrame(told, EVENT), markers)


def test_a_chain_above_the_root_needs_no_table_a_vertex(spark, markers, monkeypatch):  # noqa: F811
    made, write = [], st.materialize
    monkeypatch.setattr(st, "materialize", lambda df, name="table": made.append(name) or write(df, name))
    one, seen = _chain(spark, 6, markers)
    one, seen, few = plain(one), {tuple(r) for r in seen.collect()}, made.count("state")
    assert few == 1 and max(k for _, k, _ in seen) > 6
    monkeypatch.setattr(st, "ALONE", 0)
    all_, again = _chain(spark, 6, markers)
    assert plain(all_) == one and {tuple(r) for r in again.collect()} == seen and made.count("state") > 7


def test_an_edge_that_leads_down_goes_by_rounds(spark, markers):  # noqa: F811
    """Latitudes that don't rise leave the vertices above a frontier untold, so that nothing is cut off."""
    w = four()
    g = w.graph(spark)
    w.lat[7] = 5.0
    low = w.graph(spark)
    w.hap[1] = [not x for x in w.hap[1]]
    seqs = w.graph(spark).sequences.where("v = 1").unionByName(g.sequences.where("v <> 1"))
    want, seen = st.propagate(st.Graph(g.vertices, g.edges, g.masks, seqs), spark.createDataFrame([(5,)], "v int"), markers)
    got, again = st.propagate(st.Graph(low.vertices, g.edges, g.masks, seqs), spark.createDataFrame([(5,)], "v int"), markers)
    assert plain(got)[:2] == plain(want)[:2] and {tuple(r) for r in again.collect()} == {tuple(r) for r in seen.collect()} and {r.v for r in seen.collect()} == {5, 7}
