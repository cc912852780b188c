"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, offsets, unused

#: Words in a block, and the fewest blocks that a source is cut into (so that small sources come near their targets too).
BLOCK_WORDS, LEAST_BLOCKS = 128, 64
#: Sources above this number are refused: their totals and targets are handled on the driver.
MAX_SOURCES = 100_000
#: Documents that share a bucket for running sums, about.
PER_BUCKET = 1_000


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap times its size; the excess is reshared by weight
    among the others until none is above."""
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = float(sum(sizes))
    while open_:
        total = math.fsum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= math.fsum(out[i] for i in over)
        open_ -= over
    return out


def _mark(key: str, text: str, seed: int):
    return F.xxhash64(F.lit(seed), F.col(key), F.col(text))


@dataclass
class Mix:
    """documents: key, h (hash of key and text), source, size, start (place in its source's shuffled word stream), s; sources: s,
    source, source_size, target, blocks, quota; schedule: slot, s, rank, epoch, block; pieces: key, s,
    block, words."""

    documents: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def reversed_bits(t: np.ndarray, m: int) -> np.ndarray:
    """The van der Corput point of each t, as a cell of 2^m."""
    out = np.zeros_like(t)
    for i in range(m):
        out |= (t >> i & 1) << (m - 1 - i)
    return out


def points_before(t: np.ndarray, cell: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
    """How many t' below each t have a cell below x; cell: that of t. The numbers below t are, for each of its bits that is set, those that
    agree with it above the bit, have 0 there and anything below: their cells are evenly spaced."""
    out = np.zeros_like(t)
    for i in range(m):
        first = cell & ((1 << (m - 1 - i)) - 1)
        out += np.where(t >> i & 1, np.clip(-((first - x) >> (m - i)), 0, 1 << i), 0)
    return out


def _product_over(a: str, b: str, less: int, c: str) -> Column:
    """(a * b - less) div c, whole numbers from 0 to 10^18: in longs where c is so small that the product of a number below it and one of blocks
    fits, else in decimals of 38 digits."""
    long = f"(({a}) * ({b}) - {less}) div {c}"
    wide = f"(cast({a} as decimal(19,0)) * cast({b} as decimal(18,0)) - {less}) div cast({c} as decimal(19,0))"
    return F.expr(f"case when greatest({a}, {c}, {b}) < 2000000000 then {long} else {wide} end")


def begin_of(block: str, blocks: str, size: str) -> Column:
    """The first word of a block: block * size div blocks."""
    return _product_over(block, size, 0, blocks)


def block_of(word: str, blocks: str, size: str) -> Column:
    """The block that holds a word, counted from 0."""
    return _product_over(f"({word} + 1)", blocks, 1, size)


def _schedule(spark, ends: list[int], blocks: list[int]) -> DataFrame:
    """(slot, s, rank, epoch, block), without a shuffle: the source of a slot is found in the cumulative quotas, and its rank among the
    source's slots is counted in closed form."""
    m = max(1, (ends[-1] - 1).bit_length())
    high = np.array(ends, np.int64)
    known = spark.sparkContext.broadcast((np.concatenate([[0], high[:-1]]), high, np.array(blocks or [1], np.int64)))  # at most MAX_SOURCES numbers

    def slots(batches):
        low, high, blocks = known.value
        for b in batches:
            t = b.column(0).to_numpy()
            cell = reversed_bits(t, m)
            inside = cell < high[-1]
            t, cell = t[inside], cell[inside]
            s = np.searchsorted(high, cell, side="right")
            rank = points_before(t, cell, high[s], m) - points_before(t, cell, low[s], m)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(s.astype(np.int32)), pa.array(rank), pa.array(rank // blocks[s]), pa.array(rank % blocks[s])], ["slot", "s", "rank", "epoch", "block"])

    return spark.range((1 << m) if ends[-1] else 0).mapInArrow(slots, "slot long, s int, rank long, epoch long, block long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=lambda i: 1 + i % 3, cap: int = 3, seed: int = 7, block_words: int = BLOCK_WORDS) -> Mix:
    """Plan a mix of all documents. Sources are ordered by code point, null last; weights(i) is the i-th's.

    A source's documents are shuffled by a seeded hash of key and text into one stream of words, cut into
    blocks of equal length (at most block_words). Its quota of slots is its target over its block length,
    to the nearest block. Slot t has the van der Corput point of t on a grid of 2^m cells; the sources'
    cumulative quotas are laid over the cells, so that each source gets its quota exactly, spread evenly
    over the schedule. The slots of a source are ranked; rank r takes block r modulo the number of its
    blocks, in epoch r div that number, and so no block more than cap times.

    Running sums have three levels (blocks of hash buckets, buckets, rows within one): a source with
    most of the rows is spread over tasks. The schedule takes no shuffle. Null texts and texts without words have size 0 and take no
    part; repeated rows are rows of their own, each with its own place. An empty table gives an empty mix.
    The number of sources is checked, as their totals pass through the driver.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long").alias("size"), _mark(key, text, seed).alias("h"))
    base = materialize(base, "sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("z"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sizes = [r.z for r in per]
    goal = targets(sizes, [weights(i) for i in range(len(per))], cap)
    blocks = [max(-(-z // block_words), LEAST_BLOCKS) if z else 1 for z in sizes]
    quota = [min(cap * b, round(g / z * b)) if z else 0 for z, g, b in zip(sizes, goal, blocks, strict=True)]
    ends = [sum(quota[: i + 1]) for i in range(len(quota))] or [0]
    buckets = [max(1, r.n // PER_BUCKET) for r in per]
    rows = [(i, r.source, z, g, b, q, e - q, e, k) for i, (r, z, g, b, q, e, k) in enumerate(zip(per, sizes, goal, blocks, quota, ends, buckets))]
    sources = spark.createDataFrame(rows, "s int, source string, source_size long, target double, blocks long, quota long, low long, high long, buckets long")
    small = F.broadcast(sources)  # at most MAX_SOURCES rows

    # places in the shuffled streams
    d = base.join(small, base.source.eqNullSafe(sources.source)).select("key", "h", base.source, "size", "s", "blocks", "source_size", F.floor((F.shiftrightunsigned("h", 33) * F.col("buckets")) / F.lit(float(1 << 31))).alias("bucket"))
    before = offsets(d.groupBy("s", "bucket").agg(F.sum("size").alias("bz")), ["s"], "bucket", "bz")
    within = Window.partitionBy("s", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.withColumn("run", F.sum("size").over(within)).join(before, ["s", "bucket"]).select("key", "h", "source", "size", "s", "blocks", "source_size", (F.col("off") + F.col("run") - F.col("size")).alias("start"))
    schedule = _schedule(spark, ends, blocks)

    # which words of which document each block holds: block i is words [i z div b, (i + 1) z div b)
    first, last = block_of("start", "blocks", "source_size"), block_of("start + size - 1", "blocks", "source_size")
    held = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low, high = begin_of("block", "blocks", "source_size"), begin_of("block + 1", "blocks", "source_size")
    words = F.least(F.col("start") + F.col("size"), high) - F.greatest("start", low)
    pieces = held.select("key", "start", "s", "block", words.alias("words")).where("words > 0")
    return Mix(placed.drop("blocks", "source_size"), sources.drop("low", "high", "buckets"), schedule, pieces)


def taken(plan: Mix) -> DataFrame:
    """(key, h, source, size, source_size, target, taken): how many of each document's words the mix takes,
    repeats counted; never over cap times its size."""
    times = plan.schedule.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))
    got = plan.pieces.join(times, ["s", "block"]).groupBy("s", "start", "key").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    all_ = plan.documents.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
    got = got.select(F.col("s").alias("gs"), F.col("start").alias("gstart"), "taken")
    joined = all_.join(got, (F.col("s") == F.col("gs")) & (F.col("at") == F.col("gstart")), "left")
    info = F.broadcast(plan.sources.select(F.col("s").alias("is"), "source_size", "target"))
    return joined.join(info, F.col("s") == F.col("is")).select("key", "h", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them: words taken over size, to the nearest number (half up).
    Rows without words go. Repeated rows share what is taken of them all. An empty table stays so; other columns, of whatever
    name, are kept."""
    k, h, mark, n, i = unused(docs.columns, "_k", "_h", "_mark", "_n", "_i")
    got = taken(mix(docs, key, text, source, seed=seed, **how)).where("size > 0")
    times = got.groupBy(F.col("key").alias(k), F.col("h").alias(h)).agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias(n)).where(F.col(n) > 0)
    marked = docs.withColumn(mark, _mark(key, text, seed))
    joined = marked.join(times, F.col(key).cast("long").eqNullSafe(F.col(k)) & (F.col(mark) == F.col(h)))
    return joined.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
