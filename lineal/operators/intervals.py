"""Sets of half-open intervals [lo, hi), one row each beside an owner."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Ranges, unused

#: An end from which on an interval counts as endless.
_FAR = 1e15


def disjoint(lo1, hi1, lo2, hi2, lo1_closed=True, hi1_closed=False, lo2_closed=True, hi2_closed=False) -> Column:
    """Whether two intervals with open or closed ends share no point. Flags may be columns or booleans."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    before = lambda hi, hc, lo, lc: F.when(c(hc) & c(lc), hi < lo).otherwise(hi <= lo)
    return before(hi1, hi1_closed, lo2, lo2_closed) | before(hi2, hi2_closed, lo1, lo1_closed)


def disconnected(lo1, hi1, lo2, hi2) -> Column:
    """Whether two intervals [lo, hi) neither overlap nor touch."""
    return (hi1 < lo2) | (hi2 < lo1)


def simplify(df: DataFrame, owner: list[str]) -> DataFrame:
    """Each owner's union as (owner, lo, hi): empty intervals go, overlapping and touching ones merge.

    Gaps and islands: a new island begins where lo is beyond the greatest hi so far. Intervals that begin together are
    combined map-side first. Rows are dealt by ranges of (owner, lo), so an owner with most rows is spread over tasks.
    """
    some = df.where("lo < hi").groupBy(*owner, "lo").agg(F.max("hi").alias("hi"))
    dealt = Ranges(some, owner, ["lo"])
    seen = dealt.running(dealt.rows, "_top", F.col("hi"), "max", before=True)
    begins = F.when(F.col("_top").isNull() | (F.col("lo") > F.col("_top")), F.col("lo"))
    marked = dealt.running(seen, "_island", begins, "last")
    return marked.groupBy(*owner, "_island").agg(F.max("hi").alias("hi")).select(*owner, F.col("_island").alias("lo"), "hi")


def union(a: DataFrame, b: DataFrame, owner: list[str]) -> DataFrame:
    cols = [*owner, "lo", "hi"]
    return simplify(a.select(*cols).unionByName(b.select(*cols)), owner)


class Cells:
    """Dyadic cells for rows that meet where they overlap.

    An interval is at home on the level whose cells are as wide as it, so it touches two of them, wherever it lies; endless ones are at home on
    the highest level. Two intervals meet on the wider one's level: a row is given the cells of its own level and of the higher ones on which
    rows of the other side are at home. A row has two cells a level, and widths that differ by a factor of 2^k make k levels, so no row makes
    cells by its width. One aggregate over both sides finds the ends and the levels in use (a few dozen numbers).
    """

    def __init__(self, a: DataFrame, b: DataFrame):
        """a: (lo, hi), b: (lo2, hi2); points are intervals whose ends are equal."""
        level = lambda lo, hi: F.ceil(F.log2(F.col(hi) - F.col(lo))).cast("int")
        side = lambda df, lo, hi, name: df.select(F.col(lo).alias("lo"), F.when(F.col(hi) < _FAR, F.col(hi)).alias("hi"), F.when(F.col(hi) < _FAR, level(lo, hi)).alias("level"), F.lit(name).alias("side"))
        at = lambda name, c: F.collect_set(F.when(F.col("side") == name, F.col(c)))
        endless = F.count_if(F.col("hi").isNull() & F.col("lo").isNotNull())
        r = side(a, "lo", "hi", "a").unionByName(side(b, "lo2", "hi2", "b")).agg(F.min("lo").alias("low"), F.greatest(F.max("lo"), F.max("hi")).alias("high"), at("a", "level").alias("a"), at("b", "level").alias("b"), endless.alias("endless")).first()
        self.low, self.high = r.low or 0.0, r.high or 0.0
        exponent = lambda x: math.frexp(x)[1] if x > 0 else -60
        self.top = exponent(self.high - self.low)
        self.base = exponent(max(abs(self.low), abs(self.high))) - 60  # numbers of cells stay within 62 bits
        more = {self.top} if r.endless else set()
        self.homes = [sorted({min(max(x, self.base), max(self.top, self.base)) for x in found} | more | {self.base}) for found in (r.a, r.b)]

    def _home(self, lo: str, hi: str) -> Column:
        own = F.when(F.col(hi) < _FAR, F.coalesce(F.ceil(F.log2(F.col(hi) - F.col(lo))).cast("int"), F.lit(self.base))).otherwise(self.top)
        return F.greatest(F.least(own, F.lit(self.top)), F.lit(self.base))

    def number(self, x: Column, level: Column) -> Column:
        """The cell of a level that holds x; what lies beyond the ends is taken to be there."""
        return F.floor(F.greatest(F.least(x, F.lit(self.high)), F.lit(self.low)) * F.pow(F.lit(2.0), -level))

    def cut(self, df: DataFrame, lo: str, hi: str, levels: list[int], level: str, cell: str, home: str) -> DataFrame:
        """df once for each of its cells, of its own level and of the higher ones among `levels`."""
        visited = F.filter(F.array(*(F.lit(x) for x in levels)).cast("array<int>"), lambda x: x > F.col(home))
        each = F.transform(F.concat(F.array(F.col(home)), visited), lambda k: F.transform(F.sequence(self.number(F.col(lo), k), self.number(F.col(hi), k)), lambda c: F.struct(k.alias("k"), c.alias("c"))))
        got = df.withColumn(home, self._home(lo, hi)).withColumn(cell, F.explode(F.flatten(each)))
        return got.withColumns({level: F.col(f"{cell}.k"), cell: F.col(f"{cell}.c")})


def overlaps(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows of a (lo, hi) and b (lo2, hi2) with equal `on` columns that overlap, each once; empty intervals overlap nothing.

    Both sides are cut into dyadic cells and joined on `on`, level and cell; a pair is kept in the cell of the wider one's level in which its
    intersection begins.
    """
    a, b = a.where("lo < hi"), b.where("lo2 < hi2")
    cells = Cells(a, b)
    level, cell, home, home2 = unused([*a.columns, *b.columns], "_level", "_cell", "_home", "_home2")
    left, right = cells.cut(a, "lo", "hi", cells.homes[1], level, cell, home), cells.cut(b, "lo2", "hi2", cells.homes[0], level, cell, home2)
    met = left.join(right, [*on, level, cell]).where("lo < hi2 and lo2 < hi").where(F.col(level) == F.greatest(home, home2))
    return met.where(F.col(cell) == cells.number(F.greatest("lo", "lo2"), F.col(level))).drop(level, cell, home, home2)


def intersect(a: DataFrame, b: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, lo, hi): each owner's points in both sets, simplified."""
    two = b.select(*owner, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = overlaps(a.select(*owner, "lo", "hi"), two, owner)
    return simplify(met.select(*owner, F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi")), owner)


def contains_points(sets: DataFrame, points: DataFrame, owner: list[str], point: str = "x") -> DataFrame:
    """points with `inside`: whether any interval of their owner's covers them. The greatest hi of those that begin at or before the
    point decides: a running maximum over ranges of (owner, place), so an owner may have any number of rows."""
    at, kind, far = unused([*points.columns, "lo", "hi", "inside"], "_at", "_kind", "_far")
    s = sets.where("lo < hi").groupBy(*owner, F.col("lo").alias(at)).agg(F.max("hi").alias(far)).withColumn(kind, F.lit(0))
    p = points.withColumn(at, F.col(point).cast("double")).withColumn(kind, F.lit(1))
    dealt = Ranges(p.unionByName(s, allowMissingColumns=True), owner, [at, kind])
    told = dealt.running(dealt.rows, "inside", F.col(far), "max").where(F.col(kind) == 1)
    return told.withColumn("inside", F.coalesce(F.col(point) < F.col("inside"), F.lit(False))).drop(dealt.part, at, kind, far)


def subset(a: DataFrame, b: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, subset): whether every interval of a's set lies within one of b's simplified intervals."""
    two = simplify(b, owner).select(*owner, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    one = a.select(*owner, "lo", "hi").where("lo < hi").distinct()
    covered = overlaps(one, two, owner).where("lo2 <= lo and hi <= hi2").select(*owner, "lo", "hi").distinct().withColumn("_ok", F.lit(True))
    told = one.join(covered, [*owner, "lo", "hi"], "left")
    every = a.select(*owner).distinct()
    return every.join(told.groupBy(*owner).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("subset")), owner, "left").select(*owner, F.coalesce("subset", F.lit(True)).alias("subset"))


def sets_disjoint(a: DataFrame, b: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, disjoint) for the owners of a: whether no interval overlaps one of b's."""
    two = b.select(*owner, F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = overlaps(a.select(*owner, "lo", "hi"), two, owner).select(*owner).distinct().withColumn("_met", F.lit(True))
    return a.select(*owner).distinct().join(met, owner, "left").select(*owner, F.col("_met").isNull().alias("disjoint"))


def hull(df: DataFrame, owner: list[str]) -> DataFrame:
    """(owner, lo, hi, width): first left and last right end; gaps count into the width."""
    return df.where("lo < hi").groupBy(*owner).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("width", F.col("hi") - F.col("lo"))
