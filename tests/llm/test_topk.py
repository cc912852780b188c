import math
import random

import pytest

from lineal.llm import topk


def brute(rows, queries, k):
    def q(v):
        return None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    c = [(i, q(v)) for i, v in rows]
    out = {}
    for i, v in queries:
        if (a := q(v)) is not None:
            s = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in c if b is not None and j != i and len(b) == len(a))
            out[i] = [(r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return {i: x for i, x in out.items() if x}


@pytest.mark.parametrize("bucket,block,seeds", [(7, 3, 2), (50, 10, 20), (2048, 256, 512)])
def test_against_brute_force(frame, monkeypatch, bucket, block, seeds):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "QUERIES", block)
    monkeypatch.setattr(topk, "SEEDS", seeds)
    monkeypatch.setattr(topk, "PART_BYTES", bucket * 200)
    rng = random.Random(bucket)
    rows = [(i, [rng.gauss(0, 1) * (5 if i % 17 == 0 else 0.2) for _ in range(8)]) for i in range(150)]
    rows += [(200, None), (201, [1.0] * 7 + [None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, []), (205, [0.0] * 8), (206, [1.0, 2.0]), (207, [2.0, 1.0]), (208, rows[0][1]), (209, rows[0][1]), (210, [-3.0] * 8)]
    df = frame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    import struct

    f32 = lambda x: None if x is None else struct.unpack("f", struct.pack("f", x))[0]
    exact = [(i, None if v is None else [f32(x) for x in v]) for i, v in rows]
    for cond in ("vec_id % 5 = 0", "vec_id >= 200", "vec_id < 0"):
        asked = df.where(cond)
        ids = {r.vec_id for r in asked.collect()}
        got = {}
        for r in topk.top_k(df, asked, 5).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {i: sorted(x) for i, x in got.items()} == brute(exact, [r for r in exact if r[0] in ids], 5)


def test_empty(frame):
    df = frame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df, 5).count() == 0
