import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineal.llm import mixing


def test_targets():
    assert mixing.targets([100, 100], [1, 3]) == [50, 150]
    assert mixing.targets([10, 100], [3, 1]) == [30, 80]
    assert mixing.targets([0, 5], [1, 1]) == [0, 5]
    assert mixing.targets([], []) == []


def shares(sizes, weights, cap=3.0):
    """Targets by bisection: each is the smaller of its cap and a common factor times its weight, and they add up to all sizes."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(cap * s, mid * w) for s, w in zip(sizes, weights)) < sum(sizes):
            low = mid
        else:
            high = mid
    return [min(cap * s, high * w) for s, w in zip(sizes, weights)]


def test_targets_against_bisection():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 2, 10, 500]) for _ in range(rng.randint(1, 8))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        got = mixing.targets(sizes, weights)
        assert all(isinstance(x, float) for x in got) and np.allclose(got, shares(sizes, weights), atol=1e-6 * max(1, sum(sizes)))


def test_places_and_ranks_of_slots():
    m = 9
    t = np.arange(1 << m)
    cell = mixing.reversed_bits(t, m)
    assert cell.tolist() == [int(f"{x:0{m}b}"[::-1], 2) for x in t.tolist()]
    for x in (0, 1, 5, 100, 257, 511, 512):
        assert mixing.points_before(t, cell, np.full(len(t), x), m).tolist() == [int((cell[:i] < x).sum()) for i in range(len(t))]


def taken_by_brute_force(plan, cap=3):
    """Words that the mix takes of each document, word by word, from the documents' sizes, sources and hashes alone."""
    docs = plan.documents.select("key", "h", "source", "size").collect()
    by = defaultdict(list)
    for r in docs:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in order]
    goal = shares(sizes, [1 + i % 3 for i in range(len(order))], cap)
    blocks = [max(-(-z // mixing.BLOCK_WORDS), mixing.LEAST_BLOCKS) if z else 1 for z in sizes]
    quota = [min(cap * b, round(g / z * b)) if z else 0 for z, g, b in zip(sizes, goal, blocks)]
    cells = [i for i, q in enumerate(quota) for _ in range(q)]
    m = max(1, (len(cells) - 1).bit_length())
    times, rank = Counter(), Counter()
    for t in range(1 << m if cells else 0):
        cell = int(f"{t:0{m}b}"[::-1], 2)
        if cell < len(cells):
            s = cells[cell]
            times[(s, rank[s] % blocks[s])] += 1
            rank[s] += 1
    out = []
    for i, s in enumerate(order):
        n = max(1, len(by[s]) // mixing.PER_BUCKET)
        at = 0
        for r in sorted(by[s], key=lambda r: (((r.h % 2**64) >> 33) * n >> 31, r.h, r.key or 0)):
            # word w belongs to the block b with b z // blocks <= w < (b + 1) z // blocks
            held = [((w + 1) * blocks[i] - 1) // sizes[i] for w in range(at, at + r["size"])]
            out.append((r.key, r["size"], sum(times[(i, b)] for b in held)))
            at += r["size"]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [10, 1000])
def test_taken_by_brute_force(frame, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "PER_BUCKET", bucket)
    df = frame([r for r in corpus() if r[0] is not None], "doc_id long, text string, source string")
    plan = mixing.mix(df)
    assert sorted(((r.key, r["size"], r.taken) for r in mixing.taken(plan).collect()), key=str) == taken_by_brute_force(plan)


def test_rows_of_the_mix(frame):
    """Each row as often as taken over size says, half up; repeats, nulls and other columns of any name."""
    rows = [(k, t, s, "x", 1) for k, t, s in corpus()] + [(None, "w " * 40, "b", "y", 2)]
    df = frame(rows, "doc_id long, text string, source string, _K string, _n int")
    out = mixing.mixed(df)
    got = Counter((r.doc_id, r.source) for r in out.collect())
    sums = defaultdict(lambda: [0, 0, 0])
    for r in mixing.taken(mixing.mix(df)).collect():
        if r["size"]:
            x = sums[(r.key, r.source)]
            x[0], x[1], x[2] = x[0] + r.taken, x[1] + r["size"], x[2] + 1
    assert out.columns == df.columns and got == {k: n * c for k, (a, b, c) in sums.items() if (n := int(a / b + 0.5))}


def test_offsets_in_two_levels(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("s"), F.floor(F.col("id") / 2).alias("part"), F.lit(2).alias("n"))
    from lineal.llm.common import offsets

    assert all(r.off == 2 * r.part for r in offsets(df, ["s"], "part", "n", per=100).collect())


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 6 + ["b", "c", "Ä", None])
        rows.append((i, "w " * rng.choice([0, 1, 3, 50, 200]), source))
    return rows + [(500, None, "b"), (501, "x", "tiny"), (502, "one two\tthree", "small"), (7, rows[7][1], rows[7][2])]


@pytest.mark.parametrize("bucket", [10, 1000])
def test_taken(frame, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "PER_BUCKET", bucket)
    rows = corpus()
    df = frame([(k, t, s, 1) for k, t, s in rows], "doc_id long, text string, source string, size int")
    plan = mixing.mix(df)
    out = mixing.taken(plan).collect()
    assert len(out) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    goal = dict(zip(order, mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    got = defaultdict(int)
    for r in out:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        got[r.source] += r.taken
    for s in order:
        assert abs(got[s] - goal[s]) <= max(mixing.BLOCK_WORDS, 1), (s, got[s], goal[s])
    again = mixing.taken(mixing.mix(df.repartition(7))).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_schedule_is_even(frame):
    """Any run of slots holds each source about as often as its share says."""
    df = frame([(i, "w " * 300, "ab"[i % 3 > 0]) for i in range(200)], "doc_id long, text string, source string")
    s = [r.s for r in mixing.mix(df, weights=lambda i: 1).schedule.orderBy("slot").collect()]
    share = s.count(0) / len(s)
    for n in range(20, len(s), 17):
        assert abs(s[:n].count(0) - n * share) < 8
    ranks = mixing.mix(df).schedule.select("s", "rank").distinct().count()
    assert ranks == mixing.mix(df).schedule.count()


def test_empty(frame):
    df = frame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mix(df)).count() == 0 and mixing.mixed(df).count() == 0
    df = frame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.taken(mixing.mix(df)).collect()] == [0, 0]


def test_places_of_very_large_sources(spark):
    """Sources of 10^13 words and more: products pass 64 bits."""
    r = random.Random(1)
    rows = []
    for size in (1, 100, 128, 129, 10**9, 4 * 10**10, 10**13, 9 * 10**15):
        for blocks in {1, min(size, 3), max(1, size // 128), max(1, size // 7)}:
            for _ in range(20):
                block = r.randrange(blocks)
                rows.append((r.choice([0, size - 1, r.randrange(size), min(size - 1, block * size // blocks)]), blocks, size, r.choice([block, blocks])))
    got = spark.createDataFrame(rows, "w long, b long, z long, k long").select("*", mixing.block_of("w", "b", "z").alias("x"), mixing.begin_of("k", "b", "z").alias("y")).collect()
    assert len(got) == len(rows) and all(q.x == ((q.w + 1) * q.b - 1) // q.z and q.y == q.k * q.z // q.b for q in got)
