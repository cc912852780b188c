"""Hard negatives of labelled vectors, by exact products of several candidates packed into one wide integer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.storage import ranked
from .common import materialize

#: Candidates in a bucket, anchors in a block, buckets that are dealt together; bytes of vectors that a task packs into buckets, about.
BUCKET, ANCHORS, DEALT, PART_BYTES = 1_024, 256, 64, 64_000_000
#: Fields of an integer wider than 64 bits.
FIELDS = 16
#: Below any score.
NONE = -(1 << 62)

_FOUND = "qid string, place int, anchor_id long, i int, positive_id long, positive_score long, vec_id long, score long"
_ARROW = pa.schema([("qid", pa.string()), ("place", pa.int32()), ("anchor_id", pa.int64()), ("i", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def packed_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of c, integers, exact.

    Components are biased to be 0 or more. As many candidates' components as fit stand in separated fields of one word, wide enough for the greatest
    sum of products, so that one multiplication by an anchor's component multiplies all of them and no field runs over. Sums are unpacked
    and the biases' share taken off. A field of more than 64 bits makes words of Python's integers, which have any width.
    """
    (n, d), low_a, low_c = c.shape, int(a.min(initial=0)), int(c.min(initial=0))
    top = d * (int(a.max(initial=0)) - low_a) * (int(c.max(initial=0)) - low_c)
    width = max(1, top.bit_length())
    kind, fields = (np.uint64, 64 // width) if width <= 64 else (object, FIELDS)
    shift = [kind(width * f) if kind is np.uint64 else width * f for f in range(fields)]
    biased = np.zeros((-(-n // fields) * fields, d), kind)
    biased[:n] = (c.astype(kind) if kind is object else c) - low_c
    words = biased[0::fields]
    for f in range(1, fields):
        words = words | (biased[f::fields] << shift[f])
    sums = ((a.astype(kind) if kind is object else a) - low_a).astype(kind) @ words.T
    mask = kind((1 << width) - 1) if kind is np.uint64 else (1 << width) - 1
    raw = np.stack([(sums >> s) & mask for s in shift], axis=2).reshape(len(a), len(words) * fields)[:, :n]
    if kind is object:
        out = raw + low_a * c.astype(object).sum(axis=1)[None, :] + low_c * a.astype(object).sum(axis=1)[:, None] - d * low_a * low_c
        if out.size and max(abs(int(out.min())), abs(int(out.max()))) >= -NONE:
            raise ValueError("a score does not fit 62 bits; take a smaller scale")
        return out.astype(np.int64)
    return raw.astype(np.int64) + low_a * c.sum(axis=1)[None, :] + low_c * a.sum(axis=1)[:, None] - d * low_a * low_c


def _leading(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores above NONE, ties by smaller key."""
    n = min(k, scores.shape[1])
    edge = np.partition(scores, -n, axis=1)[:, -n][:, None]
    row, col = np.nonzero((scores >= edge) & (scores > NONE))
    order = np.lexsort((keys[col], -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows.field("key").to_numpy(), rows.field("label").to_numpy(), _matrix(rows.field("v"))


def _rows(parts: list[tuple]) -> pa.RecordBatch:
    cols = zip(*parts, strict=True) if parts else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, f.type) for x in c]) if c else pa.array([], f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _positives(k: int):
    def run(batches):
        for b in batches:
            parts = []
            for qid, asked, rows in zip(b.column("qid").to_pylist(), b.column("asked"), b.column("rows"), strict=True):
                (ak, al, av), (ck, cl, cv) = _parts(asked.values), _parts(rows.values)
                scores = np.where((al[:, None] == cl[None, :]) & (ak[:, None] != ck[None, :]), packed_products(av, cv), NONE)
                row, col = _leading(scores, ck, k)
                none = np.zeros(len(row), np.int64)
                parts.append(([qid] * len(row), row, ak[row], none, none, none, ck[col], scores[row, col]))
            yield _rows(parts)

    return run


def bounds(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest whole x with low * score <= 100 * x <= high * score; no product leaves 64 bits."""
    whole, rest = np.divmod(score, 100)
    return low * whole - (-low * rest) // 100, high * whole + high * rest // 100


def _negatives(k: int, low: int, high: int):
    def run(batches):
        for b in batches:
            parts = []
            for qid, asked, found, rows in zip(*(b.column(c) for c in ("qid", "asked", "found", "rows")), strict=True):
                (ak, al, av), (ck, cl, cv), f = _parts(asked.values), _parts(rows.values), found.values
                place, i, positive, score = (f.field(c).to_numpy() for c in ("place", "i", "positive_id", "positive_score"))
                products = packed_products(av, cv)
                products[(al[:, None] == cl[None, :]) | (ak[:, None] == ck[None, :])] = NONE
                for j in np.unique(i):
                    own = np.nonzero(i == j)[0]
                    least, most = bounds(score[own], low, high)
                    scores = products[place[own]]
                    row, col = _leading(np.where((scores >= least[:, None]) & (scores <= most[:, None]), scores, NONE), ck, k)
                    at = own[row]
                    parts.append(([qid.as_py()] * len(row), place[at], ak[place[at]], i[at], positive[at], score[at], ck[col], scores[row, col]))
            yield _rows(parts)

    return run


def _blocks(df: DataFrame, per: int, name: str, rows: str) -> DataFrame:
    """Rows in blocks of `per`: (name, dim, first, last, rows), labels from first to last. Blocks are cut from ranges of (dim, label, key), so a label of any
    size has many."""
    size = df.agg(F.sum(8 * F.col("dim") + 40)).first()[0] or 0
    order = ["dim", "label", "key"]
    dealt = df.repartitionByRange(max(1, -(-size // PART_BYTES)), *order).withColumn("part", F.spark_partition_id())
    cut = dealt.withColumn("seq", F.floor((F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1) / per))
    packed = cut.groupBy("part", "seq", "dim").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.collect_list(F.struct("key", "label", "v")).alias(rows))
    return packed.select(F.concat_ws("-", "part", "seq", "dim").alias(name), "dim", "first", "last", rows)


def mine(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor its `positives` highest other rows of df with its
    label, and for each of these the `negatives` highest rows of other labels whose score lies between `low` and `high` hundredths of the positive's. Scores are
    integer inner products of floor(scale * component); ties go to the smaller key; fewer rows if there are fewer.

    Blocks of anchors meet buckets of candidates; buckets are dealt in lots of DEALT, to which blocks are sent, so a bucket moves once and a block
    once for each lot. Positives come from the lots that hold the block's labels alone, negatives from all. Each meeting keeps its best only, and each task those of
    its meetings. See packed_products for the scores.

    Rows with a null key, label or vector, without components, or with a null or non-finite one take no part. Vectors of unlike numbers of components never
    meet. Keys and labels are whole numbers. A repeated key is a row each, as positive or negative, but never of an anchor with that key; repeated anchors of one
    key, label and vector are one. No anchors or no rows: an empty result. Other columns are not read.
    """
    x = F.transform(vector, lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))

    def shaped(rows: DataFrame) -> DataFrame:
        some = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
        return some.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"), F.size(vector).alias("dim"))

    buckets = materialize(_blocks(materialize(shaped(df), "vectors"), BUCKET, "cid", "rows"), "buckets")
    blocks = materialize(_blocks(materialize(shaped(anchors).dropDuplicates(["key", "label", "v"]), "anchors"), ANCHORS, "qid", "asked"), "blocks")
    n = buckets.count()
    lots = max(-(-n // DEALT), min(n, 2 * df.sparkSession.sparkContext.defaultParallelism), 1)
    numbered = ranked(buckets.select("cid", "dim", "first"), ["dim", "first", "cid"], "number")
    lot_of = numbered.select("cid", F.floor((F.col("number") - 1) * lots / max(n, 1)).cast("int").alias("lot"))
    dealt = materialize(buckets.withColumnRenamed("first", "from").withColumnRenamed("last", "to").join(lot_of, "cid"), "lots")

    labels = lambda t, rows, name: t.select(name, "dim", F.explode(F.array_distinct(F.transform(rows, lambda r: r.label))).alias("label")).distinct()
    meet = labels(blocks, "asked", "qid").join(labels(dealt, "rows", "lot"), ["dim", "label"]).select("qid", "lot").distinct()
    here = (F.col("dim") == F.col("size")) & (F.col("first") <= F.col("to")) & (F.col("from") <= F.col("last"))
    sized = dealt.withColumnRenamed("dim", "size")
    alike = meet.join(blocks, "qid").join(sized, "lot").where(here).select("qid", "asked", "rows").mapInArrow(_positives(positives), _FOUND)
    best = Window.partitionBy("qid", "place").orderBy(F.desc("score"), "vec_id")
    chosen = alike.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
    found = chosen.groupBy("qid").agg(F.collect_list(F.struct("place", F.col("r").alias("i"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))).alias("found"))
    asked = materialize(blocks.join(found, "qid"), "anchors-with-positives")

    sent = asked.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    one = (F.col("first") == F.col("last")) & (F.col("from") == F.col("to")) & (F.col("first") == F.col("from"))
    unlike = sent.repartition(lots, "lot").join(sized, "lot").where((F.col("dim") == F.col("size")) & ~one).select("qid", "asked", "found", "rows").mapInArrow(_negatives(negatives, low, high), _FOUND)
    order = Window.partitionBy("qid", "place", "i").orderBy(F.desc("score"), "vec_id")
    told = unlike.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
