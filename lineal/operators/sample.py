"""Samples: markers, positions and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from .intervals import Cells
from .sequences import packed_form
from .storage import Ranges, unused


def parameters(haplotypes: DataFrame, mu: float = 1e-8, rho: float = 0.0, ne: float = 1e4) -> DataFrame:
    """One row (n, mu, rho, ne) for a sample."""
    return haplotypes.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(mu).alias("mu"), F.lit(rho).alias("rho"), F.lit(ne).alias("ne"))


def rate(name: str, haploid: Column) -> Column:
    """A stored diploid rate or size, doubled for haploids."""
    return F.when(haploid, 2 * F.col(name)).otherwise(F.col(name))


def fit_positions(markers: DataFrame) -> DataFrame:
    """(m, b, sequence_length): the least-squares line position = b + m idx, and the last position."""
    return markers.agg(F.regr_slope("position", "idx").alias("m"), F.regr_intercept("position", "idx").alias("b"), F.max("position").alias("sequence_length"))


def idx_to_pos(asked: DataFrame, markers: DataFrame) -> DataFrame:
    """(idx, position); a number without a marker, such as 0, is at 0."""
    return asked.join(markers, "idx", "left").select("idx", F.coalesce("position", F.lit(0.0)).alias("position"))


def pos_to_idx(asked: DataFrame, markers: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys and idx: for each position the smallest marker at or after it, the last marker beyond.

    A forward as-of join: markers and questions stand in one falling order of position, dealt by ranges; each question gets the
    last marker met, from its own range or carried over from the ranges before.
    """
    m = markers.select((-F.col("position")).alias("_at"), F.lit(0).alias("_kind"), F.col("idx").alias("_idx"))
    ask = asked.select(*keys, (-F.col(pos).cast("double")).alias("_at"), F.lit(1).alias("_kind"))
    dealt = Ranges(ask.unionByName(m, allowMissingColumns=True), [], ["_at", "_kind"])  # a marker answers questions at its place
    told = dealt.running(dealt.rows, "idx", F.col("_idx"), "last").where("_kind = 1")
    last = markers.agg(F.max("idx").alias("_last"))
    return told.crossJoin(F.broadcast(last)).select(*keys, F.coalesce("idx", "_last").alias("idx"))  # one row


def markers_in(ranges: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """keys and idx of the markers with lo <= position < hi: ranges lie in one or two dyadic cells of their own level, markers look
    into one cell of each level in use."""
    some = ranges.where("lo < hi").select(*keys, "lo", "hi")
    level, cell, home = unused([*some.columns, "idx", "position", "lo2", "hi2"], "_level", "_cell", "_home")
    at = F.col("position").cast("double")
    points = markers.select("idx", "position", at.alias("lo2"), at.alias("hi2"))
    cells = Cells(some, points)
    cut = cells.cut(some, "lo", "hi", [], level, cell, home).drop(home)
    looking = cells.cut(points, "lo2", "hi2", cells.homes[0], level, cell, home).drop(home)
    return cut.join(looking, [level, cell]).where("lo <= position and position < hi").select(*keys, "idx", "position")


def interval_masks(ranges: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """(key, n, mask): ones at the markers that any of the key's intervals covers. Markers are numbered in order of
    position, so each interval's mask is a range of numbers."""
    hit = markers_in(ranges, markers, [key]).groupBy(key, bits.chunk_of(F.col("idx")).alias("chunk")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bits.place_in_chunk(F.col("idx")) - 1).cast("int"))).alias("b"))
    per = hit.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("chunk", "b"))).alias("m"))
    n = markers.agg(F.max("idx").alias("n"))
    every = ranges.select(key).distinct().join(per, key, "left").crossJoin(F.broadcast(n))
    chunk = F.transform(F.sequence(F.lit(1), bits.n_chunks(F.col("n"))), lambda c: F.coalesce(F.element_at("m", c), F.lit(0).cast("long")))
    return every.select(key, "n", chunk.alias("mask"))


def from_bit_matrix(matrix: DataFrame) -> DataFrame:
    """(v, n, chunks) of (row, col, bit): each column is a haplotype, each row a marker, both from 1."""
    return packed_form(matrix.select(F.col("col").alias("v"), F.col("row").alias("idx"), (F.col("bit") != 0).alias("derived")))
