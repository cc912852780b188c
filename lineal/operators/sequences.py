"""Haplotype relations: packed and long forms, distances in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits

#: Haplotypes in a block where all meet all, at least and at most, and blocks that there are unless one of them forbids it.
BLOCK, FEW = (256, 4096), 32
#: Haplotypes in a lot that meets all blocks, at least and, beyond LOTS lots, at most; parts of the blocks.
LOT, LOTS, PARTS = (40, 1024), 128, 4
#: Chunks up to which distances are written out chunk by chunk.
UNROLLED = 64
#: Haplotypes of one block that are compared with the other block at a time.
STRIP = 256
#: Above any distance.
_FAR = np.iinfo(np.int32).max


def long_form(haplotypes: DataFrame) -> DataFrame:
    """(v, idx, derived) of packed (v, n, chunks)."""
    return haplotypes.select("v", F.posexplode(bits.unpack(F.col("chunks"), F.col("n"))).alias("p", "derived")).select("v", (F.col("p") + 1).alias("idx"), "derived")


def packed_form(long: DataFrame) -> DataFrame:
    """(v, n, chunks) of (v, idx, derived), without gaps in idx: one shuffle, combined map-side per chunk."""
    bit = F.when(F.col("derived"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("idx") - 1, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    parts = long.groupBy("v", bits.chunk_of(F.col("idx")).alias("chunk")).agg(F.bit_or(bit).alias("bits"), F.max("idx").alias("n"))
    return parts.groupBy("v").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("chunk", "bits"))), lambda x: x.bits).alias("chunks"))


def neighbours(haplotypes: DataFrame) -> DataFrame:
    """Each haplotype (v, n, a) with the one numbered next (b): an equi-join."""
    nxt = haplotypes.select((F.col("v") - 1).alias("v"), F.col("chunks").alias("b"))
    return haplotypes.select("v", "n", F.col("chunks").alias("a")).join(nxt, "v")


def _blocks(n: int, block: int | None) -> int:
    """Blocks for n haplotypes: of `block` each, else of BLOCK[1], and of fewer while there would be under FEW blocks, but not under BLOCK[0]."""
    return max(1, -(-n // (block or min(max(BLOCK[0], -(-n // FEW)), BLOCK[1]))))


def distance_matrix(haplotypes: DataFrame, distance: Callable[[Column, Column], Column] = bits.hamming, block: int | None = None) -> DataFrame:
    """(i, j, d) for all i and j: the distance is any function of two chunk columns, and 0 from a haplotype to itself.

    Haplotypes are packed into blocks, a row each, and each lot of haplotypes meets each part of the blocks. A task reads its lot and its part, so that no
    haplotype is shuffled more than twice, however many there are, and pairs are made where they are written. A task holds one part of the blocks.
    """
    n, *lengths = haplotypes.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()
    least, most = (-(-(x or 0) // bits.CHUNK) for x in lengths)
    if distance is bits.hamming and least == most and 0 < most <= UNROLLED:
        distance = bits.hamming_of(most)
    lots = max(1, min(-(-n // LOT[0]), max(LOTS, -(-n // LOT[1]))))
    one = haplotypes.select(F.col("v").alias("i"), F.col("chunks").alias("ci")).repartition(lots)
    two = _packed(haplotypes, _blocks(n, block)).select(F.transform("rows", lambda x: F.struct(x.v.alias("j"), x.chunks.alias("cj"))).alias("others"))
    d = F.when(F.col("i") == F.col("j"), 0).otherwise(distance(F.col("ci"), F.col("cj")))
    # block by block: numbers that come again soon are written as a dictionary's
    met = two.repartition(PARTS).crossJoin(one.hint("shuffle_replicate_nl"))
    return met.select("i", "ci", F.inline("others")).select("i", "j", d.cast("int").alias("d"))


def _packed(haplotypes: DataFrame, blocks: int) -> DataFrame:
    """(b, rows): haplotypes dealt into blocks, those of a block in the order of their numbers."""
    own = F.pmod(F.xxhash64("v"), F.lit(blocks))
    return haplotypes.groupBy(own.alias("b")).agg(F.sort_array(F.collect_list(F.struct("v", "chunks"))).alias("rows"))


def _meet(one: DataFrame, two: DataFrame) -> DataFrame:
    """All rows of one beside all of two: each pair of their parts is a task that reads both, and nothing is broadcast, whatever sizes Spark guesses."""
    return one.crossJoin(two.repartition(PARTS).hint("shuffle_replicate_nl"))


def nearest(haplotypes: DataFrame, block: int | None = None) -> DataFrame:
    """(v, nearest, d): each haplotype's nearest other, the smallest number on ties; none for one without others.

    Each pair of blocks meets once, as in distance_matrix without copies of blocks in a shuffle or a broadcast; of a meeting only each member's best is kept, so
    that rows grow with haplotypes times blocks and not with pairs. Lengths may differ between haplotypes only if their chunks don't.
    """
    blocks = _blocks(haplotypes.count(), block)
    packed = _packed(haplotypes, blocks)
    one = packed.select(F.col("b").alias("x"), F.col("rows").alias("one")).repartition(blocks)
    met = _meet(one, packed.select(F.col("b").alias("y"), F.col("rows").alias("two"))).where("x <= y").select("one", "two")

    def found(v, a, w, b):
        """(number, distance, number of the nearest) of all members of both blocks, STRIP rows of the first at a time."""
        least, at = np.full(len(w), _FAR), np.zeros(len(w), np.int64)
        for i in range(0, len(v), STRIP):
            own, d = slice(i, i + STRIP), np.zeros((len(v[i : i + STRIP]), len(w)), np.int32)
            for c in range(a.shape[1]):
                d += np.bitwise_count(a[own, c, None] ^ b[None, :, c])
            d[v[own, None] == w[None, :]] = _FAR
            first = d.argmin(axis=1)  # rows stand by number, so the first is the smallest
            yield v[own], d[np.arange(len(d)), first], w[first]
            first = d.argmin(axis=0)
            now = d[first, np.arange(len(w))]
            least, at = np.where(now < least, now, least), np.where(now < least, first + i, at)
        yield w, least, v[at]

    def best(batches):
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                (v, a), (w, b) = ((x.values.field("v").to_numpy(), np.stack(x.values.field("chunks").to_numpy(zero_copy_only=False)).view(np.uint64)) for x in (one, two))
                v, d, j = (np.concatenate(x) for x in zip(*found(v, a, w, b), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x[d < _FAR].astype(np.int32)) for x in (v, d, j)], ["v", "d", "j"])

    return met.mapInArrow(best, "v int, d int, j int").groupBy("v").agg(F.min(F.struct("d", "j")).alias("m")).select("v", F.col("m.j").alias("nearest"), F.col("m.d").alias("d"))


def binned(haplotypes: DataFrame, bins: Column) -> DataFrame:
    """(v, bins, bin, n): derived markers in each of `bins` runs of markers, as equal as can be, longer ones first."""
    some = haplotypes.select("v", "n", bins.cast("int").alias("bins"), F.posexplode(bits.unpack(F.col("chunks"), F.col("n"))).alias("i", "derived"))
    q, r = F.floor(F.col("n") / F.col("bins")), F.col("n") % F.col("bins")
    at = F.when(F.col("i") < r * (q + 1), F.floor(F.col("i") / (q + 1))).otherwise(r + F.floor((F.col("i") - r * (q + 1)) / q))
    return some.groupBy("v", "bins", at.cast("int").alias("bin")).agg(F.sum(F.col("derived").cast("int")).alias("n"))


def laws(pairs: DataFrame, own: Column | None = None) -> DataFrame:
    """(law, violations) of the algebra of sequences over pairs (n, a, b); own: what stands for `a` on the left sides, `a` itself
    if not given."""
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    x = a if own is None else own
    one, zero = bits.ones(n), bits.zeros(n)
    checks = {
        "equal to itself": x == a,
        "text round trip": bits.parse(bits.to_string(x, n)) == a,
        "double complement": bits.not_(bits.not_(x, n), n) == a,
        "xor with zeros": bits.xor_(x, zero) == a,
        "xor with itself": bits.xor_(a, x) == zero,
        "xor with ones": bits.xor_(x, one) == bits.not_(a, n),
        "and with ones": bits.and_(x, one) == a,
        "and with zeros": bits.and_(x, zero) == zero,
        "or with zeros": bits.or_(x, zero) == a,
        "or with ones": bits.or_(x, one) == one,
        "complement of and": bits.not_(bits.and_(x, b), n) == bits.or_(bits.not_(a, n), bits.not_(b, n)),
    }
    counts = [F.count_if(~ok).alias(f"c{i}") for i, ok in enumerate(checks.values())]
    row = pairs.agg(*counts)
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("law"), F.col(f"c{i}").alias("violations")) for i, name in enumerate(checks)))).alias("x")).select("x.law", "x.violations")
