"""Exact maximum inner products by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import Ranges, ranked
from .common import materialize

#: Vectors in a bucket, queries in a block, longest vectors that give the first bound.
BUCKET, QUERIES, SEEDS = 2_048, 256, 512
#: Local cosine threshold from which a bucket is pruned by coordinates rather than by length.
COORDINATES_FROM = 0.6
#: Coordinates of a query that the coordinate bound looks at.
FOCUS = 8
#: Bytes of vectors that a task packs into buckets, about.
PART_BYTES = 64_000_000
#: Below any score.
NONE = -(1 << 62)


def quantised(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(key, v array<long>): floor(scale * x), x as double. Null vectors and keys, vectors with null or
    non-finite components, and empty vectors are left out."""
    x = F.transform(vector, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine).select(F.col(key).cast("long").alias("key"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where no sum can pass 2^53, else by integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 2**53 else a @ b.T


def _best(q: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int):
    """Rows (query, key, score) of each query's k best of one block, itself left out."""
    scores = np.where(keys[None, :] == q[:, None], NONE, scores)
    n = min(k, scores.shape[1])
    edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
    row, col = np.nonzero((scores >= edge) & (scores > NONE))
    order = np.lexsort((keys[col], -scores[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, row)
    keep = np.arange(len(row)) - start < k
    return q[row[keep]], keys[col[keep]], scores[row[keep], col[keep]]


_OUT = "query_id long, vec_id long, score long"


def _table(parts) -> pa.RecordBatch:
    cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else ([], [], []))]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], ["query_id", "vec_id", "score"])


def _blocks(df: DataFrame, per: int, order: str) -> DataFrame:
    """Rows packed into blocks of about `per`: (dim, block, keys, vs, low, high of `order`). Blocks are
    ranges of `order`, dealt by a range shuffle; equal values may cross blocks, so no block is unbounded."""
    size = df.agg(F.sum(8 * F.col("dim") + 32)).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    dealt = df.repartitionByRange(parts, "dim", order, "key")
    packed = dealt.withColumn("part", F.spark_partition_id())
    seq = F.floor((F.row_number().over(Window.partitionBy("part").orderBy("dim", order, "key")) - 1) / per)
    packed = packed.withColumn("seq", seq)
    return packed.groupBy("part", "seq", "dim").agg(F.collect_list(F.struct("key", "v", "norm")).alias("rows"), F.min("norm").alias("low"), F.max("norm").alias("high"))


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with rows of df
    other than its own key; ties go to the smaller vec_id; fewer rows if there are fewer candidates.

    Rows are quantised (see quantised), sorted by length and cut into buckets. Each query is first scored
    against the longest SEEDS vectors; its k-th best score there is a lower bound. Per bucket, bound /
    (query length * bucket's longest) is the local cosine threshold: above 1 the bucket is skipped for
    the query; a high one prunes by coordinates (the query's largest coordinates times theirs plus the
    Cauchy-Schwarz bound of the rest), a low one by length. What is left is scored exactly. Query blocks
    meet only the buckets that survive. Vectors of different lengths never meet; repeated keys are
    candidates each, but never of a query with that key; a query repeated is one query per key and vector.
    No queries or no candidates: an empty result.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))
    shape = lambda d: quantised(d, key, vector, scale).withColumns({"norm": norm, "dim": F.size("v")})
    all_ = materialize(shape(df), "vectors")
    asked = materialize(shape(queries).dropDuplicates(["key", "v"]), "queries")

    seeds = all_.orderBy(F.desc("norm"), "key").limit(SEEDS).select("key", "v", "dim", "norm").collect()  # SEEDS rows at most
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in seeds}:
        own = [r for r in seeds if r.dim == dim]
        by_dim[dim] = (np.array([r.key for r in own], np.int64), np.array([r.v for r in own], np.int64))

    def bound(batches):
        for b in batches:
            keys, dims = b.column(0).to_numpy(), b.column(2).to_numpy()
            low = np.full(len(keys), NONE, np.int64)
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                if (dim in by_dim) and len(by_dim[dim][0]) > k:
                    sk, sv = by_dim[dim]
                    scores = _products(_matrix(b.column(1).take(pa.array(at))), sv)
                    scores = np.where(sk[None, :] == keys[at][:, None], NONE, scores)
                    low[at] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], ["key", "v", "dim", "norm", "bound"])

    asked = asked.select("key", "v", "dim", "norm").mapInArrow(bound, "key long, v array<long>, dim int, norm double, bound long")
    # queries of like need (bound over length) share blocks, so that a block's weakest need prunes well
    need = F.when(F.col("norm") > 0, F.col("bound") / F.col("norm")).otherwise(-float("inf"))
    q = asked.withColumn("need", need)
    nq = F.floor(F.row_number().over(Window.partitionBy("part").orderBy("dim", "need", "key")) / QUERIES)
    q = q.repartitionByRange(F.col("dim"), F.col("need"), F.col("key")).withColumn("part", F.spark_partition_id()).withColumn("seq", nq)
    qb = q.groupBy("part", "seq", "dim").agg(F.collect_list(F.struct("key", "v", "norm", "bound")).alias("asked"), F.min("need").alias("need"))
    qb = materialize(qb.withColumn("qid", F.concat_ws("-", "part", "seq", "dim")).select("qid", "dim", "need", "asked"), "query-blocks")
    cb = materialize(_blocks(all_, BUCKET, "norm").withColumn("cid", F.concat_ws("-", "part", "seq", "dim")).select("cid", "dim", "low", "high", "rows"), "buckets")

    # buckets of one dimension are numbered from the longest on; a query block meets the first of them, as far as its bound says.
    # Only numbers meet here: one row per QUERIES queries and per BUCKET vectors
    numbers = materialize(ranked(cb.select("cid", "dim", (-F.col("high")).alias("short")), ["dim", "short", "cid"], "number"), "bucket-numbers")
    needs = qb.select("qid", "dim", F.when(F.col("need") > 0, -(F.col("need") - 1e-9) / (1 + 1e-9)).otherwise(float("inf")).alias("short"), F.lit(1).alias("kind"))
    line = needs.unionByName(numbers.select("dim", "short", F.lit(0).alias("kind"), "number"), allowMissingColumns=True)
    dealt = Ranges(line, ["dim"], ["short", "kind"])
    upto = dealt.running(dealt.rows, "last", F.col("number"), "max").where("kind = 1 and last is not null").select("qid", "dim", "last")
    starts = numbers.groupBy("dim").agg(F.min("number").alias("first"))
    near = upto.join(starts, "dim").select("qid", F.explode(F.sequence("first", "last")).alias("number")).join(numbers.select("number", "cid"), "number").select("qid", "cid")
    pairs = near.join(qb.select("qid", "asked"), "qid").join(cb.select("cid", "rows"), "cid").select("asked", "rows")

    def score(batches):
        for b in batches:
            parts = []
            for asked_rows, rows in zip(b.column(0), b.column(1), strict=True):
                a, c = asked_rows.values, rows.values
                parts += list(_pair(a, c, k))
            yield _table(parts)

    found = pairs.mapInArrow(score, _OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return placed.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pair(a: pa.StructArray, c: pa.StructArray, k: int):
    """The k best rows of one query block in one bucket, by local cosine thresholds."""
    qk, qv, qn, qb = a.field("key").to_numpy(), _matrix(a.field("v")), a.field("norm").to_numpy(), a.field("bound").to_numpy()
    ck, cv, cn = c.field("key").to_numpy(), _matrix(c.field("v")), c.field("norm").to_numpy()
    longest = cn.max(initial=0.0)
    slack = 1e-6
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(qn > 0, qb / qn, -np.inf)
        local = np.where(qn * longest > 0, qb / (qn * longest), np.where(qb > 0, np.inf, -np.inf))
    live = local <= 1 + slack
    by_length, by_coordinate = live & (local < COORDINATES_FROM), live & (local >= COORDINATES_FROM)
    at = np.nonzero(by_length)[0]
    if len(at):
        fit = np.nonzero(cn * (1 + slack) + slack >= need[at].min())[0]
        if len(fit):
            yield _best(qk[at], ck[fit], _products(qv[at], cv[fit]), k)
    for i in np.nonzero(by_coordinate)[0]:
        focus = np.argsort(-np.abs(qv[i]))[:FOCUS]
        part = cv[:, focus].astype(np.float64) @ qv[i][focus].astype(np.float64)
        rest_q = max(0.0, qn[i] ** 2 - float((qv[i][focus].astype(np.float64) ** 2).sum())) ** 0.5
        rest_c = np.sqrt(np.maximum(0.0, cn**2 - (cv[:, focus].astype(np.float64) ** 2).sum(axis=1)))
        fit = np.nonzero((part + rest_q * rest_c) * (1 + slack * np.sign(part + rest_q * rest_c)) + slack + abs(qb[i]) * slack >= qb[i])[0]
        if len(fit):
            yield _best(qk[i : i + 1], ck[fit], _products(qv[i : i + 1], cv[fit]), k)
