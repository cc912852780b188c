"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

#: Labelled rows that the model is fitted on at most (the first by a hash of the key); terms that it weighs.
SAMPLE, TERMS = 12_000, 1_024
#: Terms are whole words, and beginnings of words of these lengths (marked by a trailing "*").
PREFIXES = range(4, 9)
#: A term is looked at if this many sampled documents hold it.
LEAST_DOCS = 3
#: Standard deviations by which a term's share of toxic rows exceeds that of others, at which it is telling: among some hundred
#: thousand terms, chance alone gives hardly one. Mentions of telling terms make the grades; weights have no such
#: edge, but a prior of a width in proportion to the deviations (1 at this many), so that what may be chance weighs little.
TELLING_Z = 5.0
#: Width of the prior of the weight of log(1 + words), and how narrow all priors are.
LENGTH_PRIOR, RIDGE = 0.3, 0.002
#: Mentions from which a toxic document is of grade 2 and of grade 3 (below: grade 1).
GRADE_EDGES = (3, 6)
#: Words whose terms a worker remembers.
MEMO = 100_000

_words = re.compile(r"\w+").findall


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if n <= len(word))]


def word_counts(text: str | None) -> Counter:
    return Counter(_words((text or "").lower()))


@dataclass
class Model:
    """P(grade <= k) = 1 / (1 + exp(w.x - thresholds[k])): one weight vector for all thresholds."""

    terms: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(3, np.inf))

    def features(self, counts: Counter, memo: dict | None = None) -> dict[int, float]:
        """Term number to log(1 + mentions); the last number holds log(1 + words)."""
        memo, found = {} if memo is None else memo, {}
        for word, n in counts.items():
            at = memo.get(word)
            if at is None:
                if len(memo) >= MEMO:
                    memo.clear()
                at = memo[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
            for i in at:
                found[i] = found.get(i, 0) + n
        out = {i: float(np.log1p(n)) for i, n in found.items()}
        out[len(self.terms)] = float(np.log1p(sum(counts.values())))
        return out

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold: (rows, thresholds), falling along a row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -50, 50)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, n_grades: int, l2: float = RIDGE, steps: int = 400, most: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Weights, at most `most` each, and ordered thresholds of a cumulative logit model, by Adam on the penalised likelihood.
    Thresholds are a first one plus exponentials, and so stay ordered."""
    n, m = x.shape
    p = np.zeros(m + n_grades - 1)
    p[m] = np.log((np.sum(grade == 0) + 1) / (np.sum(grade > 0) + 1))
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:m], np.exp(p[m + 1 :])
        theta = p[m] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = x @ w
        low = 1 / (1 + np.exp(-np.clip(theta[None, :] - eta[:, None], -50, 50)))  # P(grade <= k)
        cdf = np.concatenate([np.zeros((n, 1)), low, np.ones((n, 1))], axis=1)
        slope = cdf * (1 - cdf)
        row = np.arange(n)
        prob = np.maximum(cdf[row, grade + 1] - cdf[row, grade], 1e-12)
        d_eta = (slope[row, grade + 1] - slope[row, grade]) / prob / n  # of the negative likelihood
        d_theta = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_theta[k] = -np.sum(slope[:, k + 1] * ((grade == k) / prob - (grade == k + 1) / prob)) / n
        g = np.concatenate([x.T @ d_eta + l2 / n * w * 50, [d_theta.sum()], [d_theta[i + 1 :].sum() * gaps[i] for i in range(n_grades - 2)]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        p -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        p[:m] = np.minimum(p[:m], most)
    return p[:m], p[m] + np.concatenate([[0.0], np.cumsum(np.exp(p[m + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Fit on at most `sample` labelled documents.

    Labels say only toxic or not, so grades are derived: 0 for rows that aren't toxic; toxic ones get 1,
    2 or 3 by how many mentions they hold of the terms most over-represented in toxic rows (GRADE_EDGES). So severity
    re-learns counts of its own features; what labels can tell of the model is whether rows are toxic, see the held-out tests.
    Repeated labels of a key count once, as toxic if any is.
    Term statistics of the sample are counted on Spark; the driver gets the chosen terms and, per sampled
    row, the counts of those alone: the `terms` most over-represented in toxic rows, each with a prior as wide as it is
    telling. Null texts are empty; null labels and labels without a document are
    left out. No toxic row, none that isn't, or no telling term: a model that finds nothing.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(toxic).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_k"), "_k").limit(sample)
    some = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k")  # `sample` short rows
    rows = materialize(some.select("_k", "_y", "_t"), "labelled")

    def held(batches):
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                seen[y > 0].update({x for w in word_counts(t.as_py()) for x in terms_of(w)})
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield told(seen)
                    seen = (Counter(), Counter())
            yield told(seen)

    def told(seen):
        found = [*seen[0], *seen[1]]
        none = lambda c: [0] * len(c)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([*none(seen[0]), *seen[1].values()], pa.int64()), pa.array([*seen[0].values(), *none(seen[1])], pa.int64())], ["term", "a", "b"])

    sizes = dict(rows.groupBy((F.col("_y") > 0).cast("int")).count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model()
    stats = rows.mapInArrow(held, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / (n0 + n1)
    z = (F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    best = stats.where((F.col("a") + F.col("b") >= LEAST_DOCS) & (F.col("a") * n0 > F.col("b") * n1)).withColumn("z", z).orderBy(F.desc("z"), "term").limit(terms).collect()
    if not best:
        return Model()
    model = Model({r.term: i for i, r in enumerate(best)}, np.zeros(len(best) + 1))
    telling = {i for i, r in enumerate(best) if r.z >= TELLING_Z and (r.a / n1) > 8 * (r.b + 0.5) / n0}
    wide = np.array([*(r.z / TELLING_Z for r in best), LENGTH_PRIOR])

    def count(batches):
        memo: dict = {}
        for b in batches:
            out = [[], [], [], []]
            for k, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                counts = word_counts(t.as_py())
                x = model.features(counts, memo)
                told = sum(n for w, n in counts.items() if telling.intersection(memo.get(w) or [model.terms[q] for q in terms_of(w) if q in model.terms]))
                grade = 0 if y <= 0 else 1 + sum(told >= e for e in GRADE_EDGES)
                for c, v in zip(out, (k, grade, list(x), list(x.values())), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.float64()))], ["k", "grade", "at", "x"])

    got = rows.withColumn("_k", F.col("_k").cast("long")).mapInArrow(count, "k long, grade int, at array<int>, x array<double>").collect()  # at most `sample` short rows
    got.sort(key=lambda r: (r.k, r.grade))
    x = np.zeros((len(got), len(best) + 1))
    for i, r in enumerate(got):
        x[i, r["at"]] = r["x"]
    mean = x[:, -1].mean()
    x[:, -1] -= mean
    x *= wide[None, :]  # a penalty on w / wide
    most = np.append(np.full(len(best), np.inf), 0.0)  # more words don't make a text worse, however long it is
    w, theta = fit_ordinal(x, np.array([r.grade for r in got]), 4, most=most)
    w = w * wide
    model.weights, model.thresholds = w, theta + w[-1] * mean
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with severity (expected grade, 0 to 3), grade (likeliest lowest grade that P(grade > k) of at
    least `threshold` reaches) and is_toxic (grade above 0). Columns of those names are replaced. One pass, no
    shuffle; null and wordless texts are scored as texts without mentions; repeated rows are scored each."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS terms

    @F.pandas_udf("severity double, grade int")
    def judge(texts):
        import pandas as pd

        m, memo = known.value, {}
        eta = np.array([sum(m.weights[i] * v for i, v in m.features(word_counts(t), memo).items()) for t in texts], float)
        above = m.above(eta) if len(eta) else np.zeros((0, 3))
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": (above >= threshold).sum(axis=1).astype("int32")})

    (judged,) = unused(docs.columns, "_judged")
    out = docs.withColumn(judged, judge(F.col(text)))
    out = out.withColumns({"severity": F.col(f"{judged}.severity"), "grade": F.col(f"{judged}.grade")}).drop(judged)
    return out.withColumn("is_toxic", F.col("grade") > 0)
