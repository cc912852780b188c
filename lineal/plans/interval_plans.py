"""Queries over interval sets of events: each user's even-numbered events against their odd-numbered ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources import fixtures as fx
from .registry import query
from .sequence_plans import IV

SETS = IV + """, a AS (SELECT user_id, lo, hi FROM iv WHERE event_id % 2 = 0), b AS (SELECT user_id, lo, hi FROM iv WHERE event_id % 2 = 1)"""


def _islands(source, owner, name):
    return f"""{name}1 AS (SELECT *, max(hi) OVER (PARTITION BY {owner} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT DISTINCT {owner}, lo, hi FROM {source}) WHERE lo < hi),
{name}2 AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY {owner} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isle FROM {name}1),
{name} AS (SELECT {owner}, min(lo) AS lo, max(hi) AS hi FROM {name}2 GROUP BY {owner}, isle)"""


def _sets(spark, sf_dir):
    e = fx.event_intervals(spark, sf_dir)
    cols = ["user_id", "lo", "hi"]
    return e.where("event_id % 2 = 0").select(*cols), e.where("event_id % 2 = 1").select(*cols)


_ENDS = ", ".join(f"{a}::boolean AS {n}" for n, a in (("lc1", "f // 8 % 2 = 1"), ("rc1", "f // 4 % 2 = 1"), ("lc2", "f // 2 % 2 = 1"), ("rc2", "f % 2 = 1")))


@query(f"""WITH {IV}, x AS (SELECT user_id, lo, hi, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2, event_id FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT event_id, (event_id % 16) AS f, lo, hi, lo2, CASE WHEN event_id % 3 = 0 THEN hi2 ELSE lo2 END AS hi2 FROM x WHERE lo2 IS NOT NULL), y AS (SELECT *, {_ENDS} FROM k)
SELECT event_id, (CASE WHEN rc1 AND lc2 THEN hi < lo2 ELSE hi <= lo2 END) OR (CASE WHEN rc2 AND lc1 THEN hi2 < lo ELSE hi2 <= lo END) AS disjoint, hi < lo2 OR hi2 < lo AS disconnected FROM y""")
def itv_isdisjoint(spark, sf_dir):
    """Each event against the user's next, under all sixteen combinations of open and closed ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = fx.event_intervals(spark, sf_dir).withColumns({"lo2": F.lead("lo").over(w), "hi3": F.lead("hi").over(w)}).where("lo2 is not null")
    e = e.withColumn("hi2", F.when(F.col("event_id") % 3 == 0, F.col("hi3")).otherwise(F.col("lo2")))
    flag = lambda b: F.floor(F.col("event_id") % 16 / b) % 2 == 1
    ends = ("lo", "hi", "lo2", "hi2")
    return e.select("event_id", iv.disjoint(*(F.col(c) for c in ends), flag(8), flag(4), flag(2), flag(1)).alias("disjoint"), iv.disconnected(*(F.col(c) for c in ends)).alias("disconnected"))


@query(f"WITH {IV}, {_islands('iv', 'user_id', 's')} SELECT user_id, lo, hi FROM s")
def itv_simplify(spark, sf_dir):
    return iv.simplify(fx.event_intervals(spark, sf_dir), ["user_id"])


@query(f"WITH {IV}, {_islands('iv', 'event_type', 's')} SELECT event_type, lo, hi FROM s")
def itv_simplify_few_owners(spark, sf_dir):
    return iv.simplify(fx.event_intervals(spark, sf_dir), ["event_type"])


@query(f"WITH {SETS}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b), {_islands('u', 'user_id', 's')} SELECT user_id, lo, hi FROM s")
def itv_union(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return iv.union(a, b, ["user_id"])


@query(f"WITH {SETS}, u AS (SELECT * FROM a UNION ALL SELECT DISTINCT user_id, 100.0 AS lo, 2000.0 AS hi FROM a), {_islands('u', 'user_id', 's')} SELECT user_id, lo, hi FROM s")
def itv_union_one(spark, sf_dir):
    a, _ = _sets(spark, sf_dir)
    return iv.union(a, a.select("user_id", F.lit(100.0).alias("lo"), F.lit(2000.0).alias("hi")).distinct(), ["user_id"])


@query(f"WITH {SETS}, c AS (SELECT a.user_id, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM a JOIN b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi), {_islands('c', 'user_id', 's')} SELECT user_id, lo, hi FROM s")
def itv_intersect(spark, sf_dir):
    return iv.intersect(*_sets(spark, sf_dir), ["user_id"])


@query(f"WITH {SETS}, c AS (SELECT user_id, greatest(lo, 5000) AS lo, least(hi, 20000) AS hi FROM a), {_islands('c', 'user_id', 's')} SELECT user_id, lo, hi FROM s")
def itv_intersect_one(spark, sf_dir):
    a, _ = _sets(spark, sf_dir)
    return iv.intersect(a, a.select("user_id", F.lit(5000.0).alias("lo"), F.lit(20000.0).alias("hi")).distinct(), ["user_id"])


@query(f"WITH {IV} SELECT event_id, EXISTS (SELECT 1 FROM iv o WHERE o.user_id = iv.user_id AND o.event_id % 2 = 0 AND o.lo <= iv.hi AND iv.hi < o.hi) AS inside FROM iv")
def itv_contains_point(spark, sf_dir):
    """Whether the end of each event lies within its user's even-numbered events."""
    e = fx.event_intervals(spark, sf_dir)
    points = e.select("event_id", "user_id", F.col("hi").alias("x"))
    return iv.contains_points(e.where("event_id % 2 = 0").select("user_id", "lo", "hi"), points, ["user_id"]).select("event_id", "inside")


@query(f"WITH {SETS}, {_islands('b', 'user_id', 's')}, t AS (SELECT a.user_id, EXISTS (SELECT 1 FROM s WHERE s.user_id = a.user_id AND s.lo <= a.lo AND a.hi <= s.hi) AS ok FROM a) SELECT user_id, bool_and(ok) AS subset FROM t GROUP BY user_id")
def itv_subset(spark, sf_dir):
    return iv.subset(*_sets(spark, sf_dir), ["user_id"])


@query(f"WITH {SETS}, m AS (SELECT DISTINCT a.user_id FROM a JOIN b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi) SELECT DISTINCT user_id, user_id NOT IN (SELECT user_id FROM m) AS disjoint FROM a")
def itv_set_isdisjoint(spark, sf_dir):
    return iv.sets_disjoint(*_sets(spark, sf_dir), ["user_id"])


@query(f"WITH {IV} SELECT user_id, min(lo) AS lo, max(hi) AS hi, max(hi) - min(lo) AS width FROM iv GROUP BY user_id")
def itv_closure(spark, sf_dir):
    """Left and right ends, width and closed hull of each user's set."""
    return iv.hull(fx.event_intervals(spark, sf_dir), ["user_id"])
