"""Tables in the folder that driver and executors share, and running numbers over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder, and any other is refused: its executors would each write to a disk of their own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineal-")
        sc.setCheckpointDir(found)
    return f"{found.rstrip('/')}/lineal-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back: cuts the lineage and outlives lost
    executors. release() deletes the tables."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete all that materialize() wrote for this application; results that were not written elsewhere can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened by underscores until no column has it, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ranked(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with a running number from 1 in the given order, as a table.

    Rows are dealt by ranges of the order and numbered within a range; ranges are offset by running counts, of
    one row per range. The dealt rows are written once, so that counts and numbers see the same ranges. Rows that
    the order does not tell apart must share a range, so the order should be total.
    """
    part, k, off = unused(df.columns, "_part", "_k", "_off")
    dealt = materialize(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(k))
    before = counts.select(part, (F.sum(k).over(Window.orderBy(part)) - F.col(k)).alias(off))
    numbered = dealt.withColumn(k, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return numbered.join(F.broadcast(before), part).withColumn(name, F.col(off) + F.col(k)).drop(part, k, off)


def running(df: DataFrame, order: str, value: str, name: str, per: int = 4096) -> DataFrame:
    """df with the running sum of `value` by a whole number `order`: sums within blocks of `per` numbers, and blocks offset by
    running sums of one row per block."""
    part, s, off = unused(df.columns, "_part", "_s", "_off")
    cut = df.withColumn(part, F.floor(F.col(order) / per))
    sums = cut.groupBy(part).agg(F.sum(value).alias(s))
    before = sums.select(part, (F.sum(s).over(Window.orderBy(part)) - F.col(s)).alias(off))
    within = F.sum(value).over(Window.partitionBy(part).orderBy(order))
    return cut.withColumn(s, within).join(before, part).withColumn(name, F.col(off) + F.col(s)).drop(part, s, off)


def followed(steps: DataFrame, keys: list[str], at: str, to: str) -> DataFrame:
    """(keys, at, to): where the chains of steps at -> to end, for each place that has a step. Chains must not
    close. Pointer doubling: each round is a self-join that doubles the reach, kept as a table."""
    s = materialize(steps.select(*keys, at, to), "steps")
    new, moved = "_new", "_moved"
    while True:
        on = s.select(*keys, F.col(at).alias(to), F.col(to).alias(new))
        out = s.join(on, [*keys, to], "left").select(*keys, at, F.coalesce(new, to).alias(to), F.col(new).isNotNull().alias(moved))
        out = materialize(out, "steps")
        s = out.select(*keys, at, to)
        if out.where(moved).isEmpty():
            return s


class Ranges:
    """Rows dealt by ranges of owner and order, written once, so that a running value is one within each range, carried over
    from the owner's earlier ranges by one row per range and owner. No owner has to fit into a task."""

    def __init__(self, df: DataFrame, owner: list[str], order: list[str]):
        (self.part,) = unused(df.columns, "_part")
        self.owner, self.order = owner, order
        self.rows = materialize(df.repartitionByRange(*owner, *order).withColumn(self.part, F.spark_partition_id()), "ranges")

    def running(self, rows: DataFrame, name: str, value: Column, how: str, before: bool = False) -> DataFrame:
        """rows (of this object, with further columns) with the greatest or last value so far that isn't null, by `how`, "max"
        or "last"; with `before`, without the row's own."""
        v, carried, own, *keys = unused([*rows.columns, name], "_value", "_carried", "_own", *(f"_{o}" for o in (self.part, *self.owner)))
        rows = rows.withColumn(v, value)
        ends = rows.groupBy(self.part, *self.owner).agg(F.max(v).alias(v) if how == "max" else F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*self.order))).alias(v))
        take = (lambda c: F.max(c)) if how == "max" else (lambda c: F.last(c, ignorenulls=True))
        earlier = Window.partitionBy(*self.owner).orderBy(self.part).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn(carried, take(v).over(earlier)).select(*(F.col(c).alias(k) for c, k in zip((self.part, *self.owner), keys)), carried)
        here = Window.partitionBy(self.part, *self.owner).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        met = rows.withColumn(own, take(v).over(here))
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip((self.part, *self.owner), keys)]
        joined = met.join(ends, same, "left")
        both = F.greatest(own, carried) if how == "max" else F.coalesce(own, carried)
        return joined.withColumn(name, both).drop(v, own, carried, *keys)
