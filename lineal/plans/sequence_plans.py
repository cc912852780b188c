"""Queries over haplotypes and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import sample as sm
from ..operators import sequences as sq
from ..sources import fixtures as fx
from ..sources import vcf
from .registry import query

HAP = """hap AS (SELECT CAST(vec_id + 1 AS INTEGER) AS v, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS idx,
                unnest(list_transform(embedding, lambda x: x > 0)) AS derived FROM embeddings)"""
STR = HAP + """, s AS (SELECT v, string_agg(CASE WHEN derived THEN '1' ELSE '0' END, '' ORDER BY idx) AS bits FROM hap GROUP BY v)"""
PAIR = HAP + """, p AS (SELECT a.v, a.idx, a.derived AS x, b.derived AS y FROM hap a JOIN hap b ON b.v = a.v + 1 AND b.idx = a.idx)"""


def _binary(op):
    return f"WITH {PAIR} SELECT v, string_agg(CASE WHEN {op} THEN '1' ELSE '0' END, '' ORDER BY idx) AS bits FROM p GROUP BY v"


def _pairs(spark, sf_dir):
    return sq.neighbours(fx.haplotypes(spark, sf_dir))


def _text(df, chunks):
    return df.select("v", bits.to_string(chunks, F.col("n")).alias("bits"))


@query(f"WITH {HAP} SELECT v, CAST(sum(derived::int) AS INTEGER) AS n_derived FROM hap GROUP BY v")
def seq_popcount(spark, sf_dir):
    return fx.haplotypes(spark, sf_dir).select("v", bits.popcount(F.col("chunks")).alias("n_derived"))


@query(f"WITH {HAP} SELECT v, CAST(count(*) AS INTEGER) AS length, count(*) = 0 AS is_empty FROM hap GROUP BY v")
def seq_length(spark, sf_dir):
    return fx.haplotypes(spark, sf_dir).select("v", F.col("n").alias("length"), (F.col("n") == 0).alias("is_empty"))


@query(f"WITH {STR} SELECT v, bits FROM s")
def seq_to_string(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    return _text(h, F.col("chunks"))


@query(f"WITH {STR} SELECT v, bits, CAST(length(replace(bits, '0', '')) AS INTEGER) AS n_derived FROM s")
def seq_parse(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir).select("v", "n", bits.parse(bits.to_string(F.col("chunks"), F.col("n"))).alias("chunks"))
    return h.select("v", bits.to_string(F.col("chunks"), F.col("n")).alias("bits"), bits.popcount(F.col("chunks")).alias("n_derived"))


@query(f"WITH {STR} SELECT v, bits FROM s")
def seq_pack(spark, sf_dir):
    """Long rows packed by a map-side combined bit_or, then printed."""
    return _text(sq.packed_form(fx.long_haplotypes(spark, sf_dir)), F.col("chunks"))


@query(f"WITH {HAP} SELECT v, idx, derived FROM hap")
def seq_iterate(spark, sf_dir):
    return sq.long_form(fx.haplotypes(spark, sf_dir))


@query(f"WITH {STR} SELECT v, translate(bits, '01', '10') AS bits FROM s")
def seq_not(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    return _text(h, bits.not_(F.col("chunks"), F.col("n")))


@query(_binary("x AND y"))
def seq_and(spark, sf_dir):
    return _text(_pairs(spark, sf_dir), bits.and_(F.col("a"), F.col("b")))


@query(_binary("x OR y"))
def seq_or(spark, sf_dir):
    return _text(_pairs(spark, sf_dir), bits.or_(F.col("a"), F.col("b")))


@query(_binary("x <> y"))
def seq_xor(spark, sf_dir):
    return _text(_pairs(spark, sf_dir), bits.xor_(F.col("a"), F.col("b")))


@query(f"WITH {STR} SELECT v, substr(bits, 6) || repeat('0', 5) AS back, repeat('0', 5) || substr(bits, 1, length(bits) - 5) AS forth FROM s")
def seq_shift(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    c, n = F.col("chunks"), F.col("n")
    return h.select("v", bits.to_string(bits.shift(c, n, -5), n).alias("back"), bits.to_string(bits.shift(c, n, 5), n).alias("forth"))


@query(f"WITH {HAP} SELECT v, CAST(sum(CASE WHEN derived THEN idx ELSE 0 END) AS DOUBLE) AS dot FROM hap GROUP BY v")
def seq_dot(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    return h.select("v", bits.dot(F.col("chunks"), F.sequence(F.lit(1), F.col("n"))).alias("dot"))


@query(f"WITH {STR} SELECT v, substr(bits, 7, 1) = '1' AS at_7, substr(bits, 5, 16) AS from_5_to_20 FROM s")
def seq_get(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    cut = F.slice(bits.unpack(F.col("chunks"), F.col("n")), 5, 16)
    return h.select("v", bits.get(F.col("chunks"), 7).alias("at_7"), F.array_join(F.transform(cut, lambda x: F.when(x, "1").otherwise("0")), "").alias("from_5_to_20"))


@query(f"WITH {STR} SELECT v, substr(bits, 1, 63) || '1' AS bits FROM s")
def seq_put(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    return _text(h, bits.put(F.col("chunks"), 64, True))


@query(f"WITH {STR} SELECT v, repeat('0', length(bits)) AS zeros, repeat('1', length(bits)) AS ones FROM s")
def seq_constructors(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    n = F.col("n")
    return h.select("v", bits.to_string(bits.zeros(n), n).alias("zeros"), bits.to_string(bits.ones(n), n).alias("ones"))


@query(f"WITH {STR}, c AS (SELECT bits, min(v) AS first, count(*) AS n FROM s GROUP BY bits) SELECT v, CAST(c.first AS INTEGER) AS first_equal, c.n AS n_equal FROM s JOIN c USING (bits)")
def seq_eq(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    classes = h.groupBy("n", "chunks").agg(F.min("v").alias("first_equal"), F.count(F.lit(1)).alias("n_equal"))
    return h.join(classes, ["n", "chunks"]).select("v", "first_equal", "n_equal")


@query(f"WITH {PAIR} SELECT v, bool_and(x = y OR idx < 3 OR idx > 10 OR idx % 2 = 0) AS equal FROM p GROUP BY v")
def seq_eq_masked(spark, sf_dir):
    """Equality with the next haplotype under two masks: markers 3 to 10, and odd markers."""
    n = F.col("n")
    odd = bits.pack(F.transform(F.sequence(F.lit(1), n), lambda i: i % 2 == 1))
    return _pairs(spark, sf_dir).select("v", bits.equal_masked(F.col("a"), F.col("b"), bits.mask_range(n, F.lit(3), F.lit(10)), odd).alias("equal"))


@query(f"WITH {HAP} SELECT DISTINCT idx, CAST(ceil(idx / 64.0) AS INTEGER) AS chunk, CAST((idx - 1) % 64 + 1 AS INTEGER) AS place FROM hap")
def chunk_index(spark, sf_dir):
    return fx.markers(spark, sf_dir).select("idx", bits.chunk_of(F.col("idx")).alias("chunk"), bits.place_in_chunk(F.col("idx")).alias("place"))


@query(f"WITH {HAP} SELECT v, string_agg(CASE WHEN idx BETWEEN v % 64 + 1 AND v % 64 + 1 + v % 7 THEN '1' ELSE '0' END, '' ORDER BY idx) AS bits FROM hap GROUP BY v")
def mask_range(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    first = F.col("v") % 64 + 1
    return _text(h, bits.mask_range(F.col("n"), first, F.least(first + F.col("v") % 7, F.col("n"))))


@query(f"WITH {PAIR} SELECT v, CAST(sum((x <> y)::int) AS INTEGER) AS d FROM p GROUP BY v")
def dist_hamming(spark, sf_dir):
    return _pairs(spark, sf_dir).select("v", bits.hamming(F.col("a"), F.col("b")).alias("d"))


@query(f"WITH {PAIR} SELECT v, CAST((x <> y) AS INTEGER) AS d FROM p WHERE idx = 1")
def dist_leftm(spark, sf_dir):
    return _pairs(spark, sf_dir).select("v", bits.left_marker(F.col("a"), F.col("b")).alias("d"))


_MATRIX = f"WITH {STR}, w AS (SELECT v, list_transform(range(0, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END) AS x FROM (SELECT CAST(vec_id + 1 AS INTEGER) AS v, embedding FROM embeddings)), d AS (SELECT a.v AS i, b.v AS j, CAST(bit_count(xor(CAST(sa.bits AS BIT), CAST(sb.bits AS BIT))) AS INTEGER) AS d FROM w a CROSS JOIN w b JOIN s sa ON sa.v = a.v JOIN s sb ON sb.v = b.v)"


@query(f"{_MATRIX} SELECT i, j, d FROM d")
def dist_matrix(spark, sf_dir):
    return sq.distance_matrix(fx.haplotypes(spark, sf_dir))


@query(f"WITH {HAP}, f AS (SELECT v, derived FROM hap WHERE idx = 1) SELECT a.v AS i, b.v AS j, CAST(a.derived <> b.derived AS INTEGER) AS d FROM f a CROSS JOIN f b")
def dist_custom(spark, sf_dir):
    """The matrix with another distance: any function of two chunk columns."""
    return sq.distance_matrix(fx.haplotypes(spark, sf_dir), bits.left_marker)


@query(f"{_MATRIX}, r AS (SELECT i AS v, j AS nearest, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d WHERE i <> j) SELECT v, nearest, d FROM r WHERE k = 1")
def nearest_haplotype(spark, sf_dir):
    return sq.nearest(fx.haplotypes(spark, sf_dir))


_LAWS = ["equal to itself", "text round trip", "double complement", "xor with zeros", "xor with itself", "xor with ones", "and with ones", "and with zeros", "or with zeros", "or with ones", "complement of and"]


@query(f"WITH {PAIR}, k AS (SELECT v, bool_or(x <> y) AS apart, bool_or(y AND NOT x) AS more FROM p GROUP BY v), l AS (SELECT unnest({_LAWS!r}) AS law) SELECT 'same' AS which, law, CAST(0 AS BIGINT) AS violations FROM l UNION ALL SELECT 'next', law, CASE WHEN law IN ('and with zeros', 'or with ones') THEN 0 WHEN law = 'complement of and' THEN (SELECT count(*) FROM k WHERE more) ELSE (SELECT count(*) FROM k WHERE apart) END FROM l")
def seq_laws(spark, sf_dir):
    """Violations of the laws by each haplotype, and if the next one is put in its place."""
    p = _pairs(spark, sf_dir)
    return sq.laws(p).withColumn("which", F.lit("same")).unionByName(sq.laws(p, F.col("b")).withColumn("which", F.lit("next")))


# sample and markers

PRICES = """mk AS (SELECT CAST(row_number() OVER (ORDER BY position) AS INTEGER) AS idx, position FROM (SELECT DISTINCT p_retailprice AS position FROM part)),
q AS (SELECT l_orderkey AS key, l_linenumber AS line, 800 + l_extendedprice % 300 AS pos FROM lineitem)"""


@query(f"WITH {PRICES} SELECT idx, position FROM mk")
def positions(spark, sf_dir):
    return fx.price_markers(spark, sf_dir)


@query(f"WITH {PRICES} SELECT count(*) AS n_markers, max(position) AS sequence_length FROM mk")
def nmarkers(spark, sf_dir):
    return fx.price_markers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_markers"), F.max("position").alias("sequence_length"))


@query(f"WITH {PRICES} SELECT round(regr_slope(position, idx), 6) AS m, round(regr_intercept(position, idx), 6) AS b, max(position) AS sequence_length FROM mk")
def sample_from_haplotypes(spark, sf_dir):
    return sm.fit_positions(fx.price_markers(spark, sf_dir)).select(F.round("m", 6).alias("m"), F.round("b", 6).alias("b"), "sequence_length")


@query(f"WITH {PRICES}, i AS (SELECT generate_series AS idx FROM generate_series(0, (SELECT max(idx) FROM mk))) SELECT CAST(i.idx AS INTEGER) AS idx, coalesce(position, 0) AS position FROM i LEFT JOIN mk USING (idx)")
def idxtopos(spark, sf_dir):
    m = fx.price_markers(spark, sf_dir)
    asked = m.select("idx").unionByName(m.groupBy().agg(F.lit(0).alias("idx")))
    return sm.idx_to_pos(asked, m)


@query(f"WITH {PRICES}, u AS (SELECT q.*, m.idx FROM q ASOF LEFT JOIN mk m ON q.pos <= m.position) SELECT key, line, CAST(coalesce(idx, (SELECT max(idx) FROM mk)) AS INTEGER) AS idx FROM u")
def postoidx(spark, sf_dir):
    return sm.pos_to_idx(fx.price_positions(spark, sf_dir), fx.price_markers(spark, sf_dir), ["key", "line"])


@query(f"WITH {PRICES}, r AS (SELECT key, line, pos AS lo, pos + line AS hi FROM q) SELECT key, line, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS n_markers FROM r JOIN mk ON lo <= position AND position < hi GROUP BY key, line")
def postoidx_interval(spark, sf_dir):
    ranges = fx.price_positions(spark, sf_dir).select("key", "line", F.col("pos").alias("lo"), (F.col("pos") + F.col("line")).alias("hi"))
    return sm.markers_in(ranges, fx.price_markers(spark, sf_dir), ["key", "line"]).groupBy("key", "line").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("n_markers"))


IV = """iv AS (SELECT event_id, user_id, event_type, CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS DOUBLE) AS lo, CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000) AS DOUBLE) + 1 + 15 * (event_id % 90) AS hi FROM events)"""


@query(f"WITH {IV}, {HAP}, m AS (SELECT DISTINCT idx FROM hap), r AS (SELECT event_id, lo % 64 AS lo, lo % 64 + (hi - lo) % 40 AS hi FROM iv) SELECT event_id, string_agg(CASE WHEN lo <= idx AND idx < hi THEN '1' ELSE '0' END, '' ORDER BY idx) AS bits FROM r CROSS JOIN m GROUP BY event_id")
def mask_interval(spark, sf_dir):
    iv = fx.event_intervals(spark, sf_dir).select("event_id", (F.col("lo") % 64).alias("lo"), (F.col("lo") % 64 + (F.col("hi") - F.col("lo")) % 40).alias("hi"))
    return sm.interval_masks(iv, fx.markers(spark, sf_dir), "event_id").select("event_id", bits.to_string(F.col("mask"), F.col("n")).alias("bits"))


@query(f"WITH {IV}, {HAP}, m AS (SELECT DISTINCT idx FROM hap), r AS (SELECT user_id, lo % 64 AS lo, lo % 64 + (hi - lo) % 5 AS hi FROM iv) SELECT user_id, string_agg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.lo <= m.idx AND m.idx < r.hi) THEN '1' ELSE '0' END, '' ORDER BY m.idx) AS bits FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN m GROUP BY user_id")
def mask_intervals(spark, sf_dir):
    iv = fx.event_intervals(spark, sf_dir).select("user_id", (F.col("lo") % 64).alias("lo"), (F.col("lo") % 64 + (F.col("hi") - F.col("lo")) % 5).alias("hi"))
    return sm.interval_masks(iv, fx.markers(spark, sf_dir), "user_id").select("user_id", bits.to_string(F.col("mask"), F.col("n")).alias("bits"))


@query(f"WITH {HAP}, x AS (SELECT count(DISTINCT v) AS n FROM hap) SELECT haploid, 2e4 * CASE WHEN haploid THEN 1 ELSE 0.5 END AS ne, 2e-8 * CASE WHEN haploid THEN 1 ELSE 0.5 END AS mu, 4e-8 * CASE WHEN haploid THEN 1 ELSE 0.5 END AS rho, n FROM x, (VALUES (true), (false)) t(haploid)")
def sample_rates(spark, sf_dir):
    h = fx.haplotypes(spark, sf_dir)
    s = sm.parameters(h, mu=1e-8, rho=2e-8, ne=1e4)
    return s.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("haploid"), "mu", "rho", "ne", "n").select("haploid", *(sm.rate(c, F.col("haploid")).alias(c) for c in ("ne", "mu", "rho")), "n")


@query(f"WITH {STR} SELECT v, bits FROM s")
def sample_from_bitmatrix(spark, sf_dir):
    """Markers by rows, haplotypes by columns, to packed haplotypes."""
    m = fx.long_haplotypes(spark, sf_dir).select(F.col("idx").alias("row"), F.col("v").alias("col"), F.col("derived").cast("int").alias("bit"))
    return _text(sm.from_bit_matrix(m), F.col("chunks"))


@query(f"WITH {HAP} SELECT CAST(v - 1 AS INTEGER) AS haplotype, CAST(idx * 10 AS DOUBLE) AS position, derived FROM hap WHERE v <= 2 * ((SELECT max(v) FROM hap) // 2)")
def read_vcf(spark, sf_dir):
    """The haplotypes written as phased diploid VCF text, and read back."""
    path = vcf.write(fx.long_haplotypes(spark, sf_dir).select((F.col("v") - 1).alias("haplotype"), (F.col("idx") * 10).alias("position"), "derived"))
    return vcf.read(spark, path)
