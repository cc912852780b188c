import math
import random
from collections import defaultdict

import numpy as np
import pytest
from sql_compare import connect, same

from lineal.llm import hard_negatives as hn
from lineal.llm import queries


@pytest.mark.parametrize(("low", "high", "d"), [(-150, 150, 64), (0, 1, 3), (5, 6, 1), (-(2**27), 2**27, 9), (-3, 1, 200), (-(10**6), 10**6, 64)])
def test_packed_products_are_exact(low, high, d):
    r = np.random.default_rng(d)
    for na, nc in ((3, 50), (1, 1), (4, 33), (0, 5), (5, 0)):
        a, c = r.integers(low, high, (na, d)), r.integers(low, high, (nc, d))
        assert (hn.packed_products(a, c) == a @ c.T).all()


def test_scores_that_a_long_cannot_hold_are_refused():
    with pytest.raises(ValueError, match="62 bits"):
        hn.packed_products(np.array([[2**40]]), np.array([[2**40]]))


def test_bounds_are_those_of_whole_numbers():
    for p in (-250, -7, 0, 1, 33, 99, 100, 101, 12345, 2**61):
        least, most = hn.bounds(np.array([p]), 30, 90)
        assert least[0] == -((-30 * p) // 100) and most[0] == 90 * p // 100


def brute(rows, positives=5, negatives=10):
    use = [(k, y, [math.floor(256 * float(x)) for x in v]) for k, y, v in rows if None not in (k, y, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    anchors = {(k, y, tuple(v)) for k, y, v in use if k % 100 == 0}
    for k, y, v in anchors:
        others = [(sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in use if j != k and len(w) == len(v)]
        order = sorted(others, key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in order if x[2] == y][:positives]:
            fit = [x for x in order if x[2] != y and 30 * p <= 100 * x[0] <= 90 * p][:negatives]
            out += [(k, j, i + 1, n, p, s) for i, (s, n, _) in enumerate(fit)]
    return sorted(out)


def run(df, **more):
    return sorted(map(tuple, hn.mine(df, df.where("vec_id % 100 = 0"), **more).collect()))


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("labels", [2, 40])
def test_against_every_pair(frame, monkeypatch, labels):
    for name, value in (("BUCKET", 16), ("ANCHORS", 3), ("DEALT", 2), ("PART_BYTES", 4_000)):
        monkeypatch.setattr(hn, name, value)
    r = random.Random(labels)
    vector = lambda d: [r.choice([r.uniform(-0.5, 0.7), 0.25]) for _ in range(d)]
    rows = [(i * 10, 0 if r.random() < 0.4 else r.randrange(labels), vector(8)) for i in range(150)]
    rows += [(i * 50 + 5000, r.randrange(3), vector(3)) for i in range(12)]
    rows += [(7, None, vector(8)), (None, 1, vector(8)), (8, 1, None), (9, 1, [float("nan")] * 8), (11, 1, [None] * 8), (300, 1, [float("inf")] * 8), (400, 0, []), (100, 9, vector(8)), (13, 0, rows[3][2]), (13, 0, rows[3][2])]
    rows += [(20_000 + i, 1, rows[1][2]) for i in range(30)]  # ties
    assert run(frame(rows, SCHEMA)) == brute(rows)


def test_no_rows_no_anchors_one_label(frame):
    assert run(frame([], SCHEMA)) == []
    assert run(frame([(1, 1, [0.5]), (2, 2, [0.5])], SCHEMA)) == []
    assert run(frame([(100, 1, [0.5]), (2, 1, [0.5])], SCHEMA)) == []


def test_clashing_names(frame):
    rows = [(100, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]), (3, 2, [0.2, 0.4]), (4, 2, [0.3, 0.2])]
    df = frame([(*r, "x", "y") for r in rows], SCHEMA + ", lot string, dim string")
    assert run(df) == brute(rows) != []


def test_repeated_keys_are_rows_each(frame):
    rows = [(100, 1, [0.5, 0.5]), (100, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5]), (2, 1, [0.5, 0.4]), (3, 2, [0.2, 0.4]), (3, 2, [0.2, 0.4])]
    got, by = run(frame(rows, SCHEMA)), defaultdict(int)
    for r in got:
        by[r[0], r[1]] += 1
    assert got == brute(rows) and dict(by) == {(100, 2): 4}


def test_the_query_against_its_sql(spark, sf_dir):
    same(queries.QUERIES["op13_hard_negatives"](spark, sf_dir), connect(sf_dir), queries.ORACLES["op13_hard_negatives"])
