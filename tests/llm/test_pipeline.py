import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from test_line_dedup import brute
from test_mixing import taken_by_brute_force
from test_simhash import kept_by_brute_force
from test_toxicity import corpus

from lineal.llm import common, mixing, pieces, toxicity
from lineal.llm.queries import MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k int, _h string"


def rows():
    """Documents with nulls, empty, repeated and long texts, copies and near copies, toxic ones, and columns of clashing names."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = lambda: " ".join(word() for _ in range(rng.randint(6, 30)))
    docs, labels = corpus(160)
    out = [(k, t, "en", f"s{k % 3}", len(t), k, "x") for k, t in docs]
    shared = [line() for _ in range(6)]
    for k in range(200, 260):
        x = [line() for _ in range(rng.randint(1, 5))] + rng.sample(shared, 2)
        if k % 2:
            words = shared[0].split(" ")
            words[rng.randrange(len(words))] = word()
            x.append(" ".join(words))
        t = "\n".join(x)
        out.append((k, t, "de", "hot", len(t), k, None))
    out += [(300, None, None, None, None, None, None), (301, "", "en", "hot", 0, 1, "y"), (302, " \t", "en", None, 2, 1, "y"), (303, out[-1][1], "fr", "s1", 3, 2, "z"), (303, out[-1][1], "fr", "s1", 3, 2, "z"), (304, "word " * 30_000, "en", "tiny", 150_000, 4, "w"), (None, line(), "en", "hot", 9, 5, "n"), (None, line(), "en", "hot", 9, 6, "n")]
    return out, labels


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = rows()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def stage(n, spark, docs, path):
    return common.materialize(cp.STAGES[n][1](spark, docs, path))


def held(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))


def test_each_stage_by_brute_force(spark, case):
    """Every stage on what its predecessor kept, row by row."""
    path, docs = case
    model = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    one = stage(0, spark, docs, path)
    toxic = lambda t: model.above(_eta(model, t))[0, 0] >= 0.5
    assert held(one) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect() if not toxic(r.text))
    assert docs.count() - one.count() >= 35

    two = stage(1, spark, one, path)
    known = [(r.doc_id, r.text) for r in one.where("doc_id is not null").collect()]
    want = brute(sorted(set(known), key=lambda x: x[0]))
    first = {r.doc_id: r.text for r in two.collect() if r.doc_id is not None}
    nulls = [r.text for r in two.where("doc_id is null").collect()]
    # rows without a key come first, and lose no line that is theirs alone
    assert first == want and len(nulls) == 2 and two.count() == one.count()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in two.collect())

    three = stage(2, spark, two, path)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in three.collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in two.collect()])

    four = stage(3, spark, three, path)
    plan = mixing.mix(three)
    sums = {}
    for k, size, n in taken_by_brute_force(plan):
        a = sums.setdefault(k, [0, 0, 0])
        a[0], a[1], a[2] = a[0] + n, a[1] + size, a[2] + (size > 0)
    assert Counter(r.doc_id for r in four.collect()) == {k: int(n / z + 0.5) * c for k, (n, z, c) in sums.items() if z and int(n / z + 0.5)}

    five = cp.STAGES[4][1](spark, four, path)
    back = pieces.decode(five, MODEL)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in four.collect()}
    per = Counter(r.doc_id for r in four.collect())
    assert Counter(r.doc_id for r in five.collect()) == {k: 2 * n for k, n in per.items()}
    for out in (one, two, three, four):
        assert out.columns == docs.columns


def _eta(model, text):
    import numpy as np

    x = model.features(toxicity.word_counts(text))
    return np.array([sum(model.weights[i] * v for i, v in x.items())])


@pytest.mark.parametrize("n", range(5))
def test_stages_take_empty_tables(spark, case, n):
    path, docs = case
    assert cp.STAGES[n][1](spark, docs.limit(0), path).count() == 0


def test_run(spark, sf_dir):
    """The whole pipeline on given tables: clean documents stay at the first stage, and every kept document is encoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.STAGES[0][1](spark, docs, sf_dir).select("doc_id").collect()}
    clean = [k for k, t in labels.items() if not t]
    assert sum(k in kept for k in clean) / len(clean) > 0.95
    out = cp.run(spark, sf_dir).collect()
    assert out and {r.doc_id for r in out} <= kept and all(r.sample in (1, 2) for r in out)
