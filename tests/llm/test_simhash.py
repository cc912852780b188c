import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from lineal.llm import common, simhash


def plain(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), 42) for i in range(max(1, len(words) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(keys, fps, distance):
    up = list(range(len(keys)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, k in enumerate(keys):
        low[root(i)] = min(low.get(root(i), k), k)
    return {k: low[root(i)] for i, k in enumerate(keys)}


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_fingerprint(shingle):
    for text in (None, "", " \t\n", "One", "One two", "One TWO three", "a b c d e f g " * 50, "É Z x\u0085y q", "w " * 120_000):
        assert simhash.simhash64(text, shingle) == plain(text, shingle)


@pytest.mark.parametrize("distance,segments", [(1, 1), (2, 1), (2, 2), (2, 3), (3, 2), (6, 3)])
def test_links_are_all_pairs_within_distance(spark, distance, segments):
    rng = random.Random(distance * 10 + segments)
    values = {0, (1 << 64) - 1}
    while len(values) < 60:
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(3):
            y = x
            for b in rng.sample(range(64), rng.randint(1, distance + 1)):
                y ^= 1 << b
            values.add(y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    v = sorted(map(signed, values))
    want = {(a, b) for i, a in enumerate(v) for b in v[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
    df = spark.createDataFrame([(x,) for x in v] * 2, "fp long")
    assert {(r.a, r.b) for r in simhash.hamming_links(df, distance, segments).collect()} == want


def test_components_against_union_find(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(35)] + [(5, 5), (0, 1)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(frame):
    rng = random.Random(5)
    text = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]
    rows = []
    for i in range(12):
        base = text(120)
        for j in range(3):
            x = list(base)
            if j:
                x[rng.randrange(120)] = "other"
            rows.append((i * 3 + j, " ".join(x)))
    rows += [(90, None), (91, ""), (92, "  "), (93, rows[0][1]), (94, "one"), (95, "ONE")]
    df = frame([(k, t, 7) for k, t in rows], "doc_id long, text string, fp int")
    fps = [plain(t, 3) for _, t in rows]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()}
    want = groups([k for k, _ in rows], fps, 2)
    assert got == {k: (f, want[k]) for (k, _), f in zip(rows, fps)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def kept_by_brute_force(rows, shingle=5, similarity=0.8):
    """(key, text) of the rows that stay; rows: (key, text). Texts are linked by their fingerprints and common shingles."""
    texts = list(dict.fromkeys(t for _, t in rows))

    def grams(t):
        words = [w for w in re.split("[ \t-\r]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()

    sets = [grams(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] and not sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for k, t in rows:
        g = root(texts.index(t))
        best.setdefault(g, set()).add((k is None, k or 0))
    return sorted(((k is None, k or 0) for k, t in rows if (k is None, k or 0) == min(best[root(texts.index(t))])))


def test_one_of_each_group_stays(frame):
    rng = random.Random(15)
    text = lambda n: [str(rng.randint(0, 10**6)) for _ in range(n)]
    rows = []
    for i in range(10):
        base = text(300)
        for j in range(4):
            x = list(base)
            for _ in range(j):
                x[rng.randrange(300)] = "other"
            rows.append((i * 4 + j, " ".join(x)))
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[4][1]), (None, " ".join(text(30))), (None, "alone by itself"), (101, None), (102, ""), (103, " \t"), (104, "one"), (105, "ONE"), (106, "w " * 60_000)]
    df = frame([(k, t, 1, "x", 2) for k, t in rows], "doc_id long, text string, _k int, _H string, node int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == kept_by_brute_force(rows)
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_a_hub_of_components(spark):
    """One node with most of the edges."""
    edges = spark.range(1, 5000).select((F.col("id") * 7).alias("a"), F.lit(0).cast("long").alias("b")).unionByName(spark.createDataFrame([(90_001, 90_000)], "a long, b long"))
    got = common.components(edges).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: 5000, 90_000: 2}


def edited(words, count, r, pool):
    out = list(words)
    for i in r.sample(range(len(out)), count):
        out[i] = r.choice(pool)
    return out


@pytest.mark.parametrize(("low", "high"), [(60, 200), (200, 500), (500, 2000)])
def test_sketches_find_edited_texts(low, high):
    """Pairs of five-word likeness 0.8 and more, whatever their fingerprints: nearly all share a sketch, and all that do are near enough."""
    r = random.Random(low)
    pool = [f"w{i}" for i in range(3000)]
    found = total = 0
    for _ in range(60):
        words = [r.choice(pool) for _ in range(r.randint(low, high))]
        for count in (1, 2, 4, 8):
            a, b = " ".join(words), " ".join(edited(words, count, r, pool))
            if simhash.likeness(a, b, 5) >= 0.8:
                (fa, sa), (fb, sb) = simhash.sketches64(a, 5), simhash.sketches64(b, 5)
                assert fa == simhash.simhash64(a, 5)
                total += 1
                found += bool(set(sa) & set(sb)) and (fa ^ fb).bit_count() <= simhash.FAR
    assert found >= 0.97 * total > 100


def test_edited_copies_go(frame):
    """One of each pair stays, in a table in which many texts share a passage."""
    r = random.Random(4)
    pool = [f"w{i}" for i in range(2000)]
    shared, rows, pairs = " ".join(r.choice(pool) for _ in range(40)), [], []
    for i in range(60):
        words = [r.choice(pool) for _ in range(r.randint(60, 300))]
        other = edited(words, r.randint(1, 3), r, pool)
        a, b = (f"{' '.join(x)} {shared}" for x in (words, other))
        rows += [(2 * i, a), (2 * i + 1, b)]
        if simhash.likeness(a, b, 5) >= 0.8:
            pairs.append(2 * i + 1)
    rows += [(1000 + i, " ".join(r.choice(pool) for _ in range(80)) + " " + shared) for i in range(60)]
    left = {x.doc_id for x in simhash.keep_one(frame(rows, "doc_id long, text string")).collect()}
    alone = {k for k, _ in rows} - set(pairs)
    assert alone <= left and len(set(pairs) & left) <= 0.05 * len(pairs) and len(pairs) > 40
