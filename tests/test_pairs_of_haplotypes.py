"""All haplotypes against all: what is shuffled and broadcast for it, and distances of any kind."""

import random

import pytest

from lineal.functions import bits
from lineal.operators import sequences as sq

SCHEMA = "v int, n int, chunks array<long>"


def _some(seed, count, n):
    rng = random.Random(seed)
    return [(v, n, [rng.getrandbits(63) if k < n // 64 else rng.getrandbits(n % 64) for k in range(-(-n // 64))]) for v in rng.sample(range(1, 10 * count), count)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("asked", [bits.hamming, bits.left_marker])
def test_matrix_copies_no_haplotype_for_each_block(spark, asked):
    """Blocks meet as parts: no copies of rows before an exchange, whose number grows with that of the blocks, and no broadcast."""
    rows = spark.createDataFrame(_some(1, 300, 64), SCHEMA)
    plan = _plan(sq.distance_matrix(rows, asked, block=10))
    assert "CartesianProduct" in plan and "Generate explode" not in plan and "Broadcast" not in plan


def test_nearest_copies_no_block(spark):
    """Neither in a shuffle nor in a broadcast, whatever threshold Spark has for guessed sizes."""
    rows = spark.createDataFrame(_some(2, 300, 64), SCHEMA)
    plan = _plan(sq.nearest(rows, block=10))
    assert "CartesianProduct" in plan and "Generate explode" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("n", [10, 64, 150])
def test_matrix_of_a_distance_that_has_a_direction(spark, n):
    """Each ordered pair is compared by itself, in any number of chunks."""
    rows = _some(3, 50, n)
    more = lambda a, b: bits.popcount(bits.and_(a, bits.xor_(a, b)))
    got = {(r.i, r.j): r.d for r in sq.distance_matrix(spark.createDataFrame(rows, SCHEMA), more, block=7).collect()}
    assert got == {(v, w): sum((x & ~y).bit_count() for x, y in zip(a, b)) for v, _, a in rows for w, _, b in rows}
    got = {(r.i, r.j): r.d for r in sq.distance_matrix(spark.createDataFrame(rows, SCHEMA), block=7).collect()}
    assert got == {(v, w): sum((x ^ y).bit_count() for x, y in zip(a, b)) for v, _, a in rows for w, _, b in rows}


def test_matrix_of_none(spark):
    assert sq.distance_matrix(spark.createDataFrame([], SCHEMA)).count() == 0 and sq.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest_over_strips(spark, monkeypatch):
    """Ties go to the smallest number wherever it stands, within a block or in another."""
    monkeypatch.setattr(sq, "STRIP", 3)
    rows = _some(4, 60, 6)
    got = {r.v: (r.d, r.nearest) for r in sq.nearest(spark.createDataFrame(rows, SCHEMA), block=16).collect()}
    assert got == {v: min((sum((x ^ y).bit_count() for x, y in zip(a, b)), w) for w, _, b in rows if w != v) for v, _, a in rows}
