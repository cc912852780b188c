import math
import os
import random
import re

import numpy as np
import pytest

from lineal.llm import toxicity as tx


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    eta = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=4000)
    grade = np.digitize(eta, [0.0, 1.5, 3.0])
    w, theta = tx.fit_ordinal(x, grade, 4)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(theta, [0, 1.5, 3.0], atol=0.3)


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    calm = [f"{a}{b}" for a in ("stone", "river", "cloud", "paper", "green") for b in range(40)]
    bad = ["vilefoo", "vilebar", "grimly", "rotten"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(frame):
    docs, labels = corpus()
    df = frame([(k, t, "x") for k, t in docs], "doc_id long, text string, grade string")
    known = frame([r for r in labels if r[0] % 3], "doc_id long, toxic int")
    model = tx.fit(df, known)
    got = {r.doc_id: (r.is_toxic, r.severity) for r in tx.score(df, model).collect()}
    held = [(got[k][0], bool(y)) for k, y in labels if k % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= s <= 3 for _, s in got.values())
    more = [r.severity for r in tx.score(frame([(1, "rotten " * 2 + "stone1 " * 60), (2, "rotten " * 9 + "stone1 " * 60)], "doc_id long, text string"), model).orderBy("doc_id").collect()]
    assert more[0] < more[1]
    odd = tx.score(frame([(1, None), (2, ""), (3, "stone1 " * 200_000), (3, "stone1 " * 200_000)], "doc_id long, text string"), model).collect()
    assert len(odd) == 4 and not any(r.is_toxic for r in odd)
    assert tx.score(df.limit(0), model).count() == 0


def test_no_labels_find_nothing(frame):
    docs, _ = corpus(20)
    df = frame(docs, "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, None), (None, 1)], [(1, 0), (2, 1)]):
        model = tx.fit(df, frame(labels, "doc_id long, toxic int"))
        assert tx.score(df, model).where("is_toxic").count() == 0


def test_scores_are_those_of_the_formula(frame):
    """Severity and grade, row by row, from the model's numbers alone; nulls, repeats and columns of clashing names."""
    docs, labels = corpus(200, seed=4)
    df = frame(docs, "doc_id long, text string")
    model = tx.fit(df, frame(labels, "doc_id long, toxic int"))
    rows = [(k, t, "a", 1) for k, t in docs[:60]] + [(1, None, "b", 2), (2, "", "c", 3), (3, docs[0][1], "d", 4), (3, docs[0][1], "d", 4), (None, docs[4][1] * 300, "e", 5)]
    out = tx.score(frame(rows, "doc_id long, text string, _judged string, GRADE int"), model)
    assert [c.lower() for c in out.columns].count("grade") == 1

    def plain(text):
        words = re.findall(r"\w+", (text or "").lower())
        x = [0] * len(model.terms)
        for term, i in model.terms.items():
            x[i] = sum(w == term or (term.endswith("*") and len(w) >= len(term) - 1 and w.startswith(term[:-1])) for w in words)
        eta = sum(w * math.log1p(n) for w, n in zip(model.weights, x)) + model.weights[-1] * math.log1p(len(words))
        p = [1 / (1 + math.exp(t - eta)) if t - eta < 50 else 0.0 for t in model.thresholds]
        return sum(p), sum(q >= 0.5 for q in p)

    want = {t: plain(t) for _, t, _, _ in rows}
    for r in out.collect():
        s, g = want[r.text]
        assert abs(r.severity - s) < 1e-9 and r.grade == g and r.is_toxic == (g > 0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no such tables")
def test_toxic_rows_held_out_of_the_given_tables(spark):
    """Fitted on even ids, odd ones are told: nine of ten toxic rows, and of the others hardly any."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels.where("doc_id % 2 = 0"))
    told = {(r.toxic, r.is_toxic): r["count"] for r in tx.score(docs.join(labels.where("doc_id % 2 = 1").select("doc_id", "toxic"), "doc_id"), model).groupBy("toxic", "is_toxic").count().collect()}
    hit, miss, wrong, right = (told.get(k, 0) for k in ((1, True), (1, False), (0, True), (0, False)))
    assert hit / (hit + miss) >= 0.9 and wrong / (wrong + right) <= 0.01, told


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no such tables")
@pytest.mark.parametrize("fold", [0, 1])
def test_few_toxic_rows_are_enough_for_most_of_the_others(spark, fold):
    """Fitted on one half of some fifty labelled toxic rows, seven of ten in the other half are told and no other row; each grade occurs."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels.where(f"doc_id % 2 = {fold}"))
    rows = tx.score(docs.join(labels.where(f"doc_id % 2 <> {fold}").select("doc_id", "toxic"), "doc_id"), model).select("toxic", "grade").collect()
    toxic = [r.grade for r in rows if r.toxic]
    assert sum(g > 0 for g in toxic) >= 0.7 * len(toxic) and set(toxic) >= {1, 2, 3}
    assert not any(r.grade for r in rows if not r.toxic)
