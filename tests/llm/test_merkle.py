import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F
from sql_compare import connect, same

from lineal.llm import merkle, queries

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels_, i):
    for level in levels_[:-1]:
        first = i // 16 * 16
        yield level[first : first + 16], i - first
        i //= 16


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: H(*map(framed, (*r[:4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[s] = levels([leaf(r, r[4]) for r in by[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            own = fold = trees[s][0][i]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                fold = leaf(r, r[4].translate(str.maketrans(UP, LOW)))
            proof = ""
            for run, at in [*path(trees[s], i), *path(top, j)]:
                proof += "".join(run[:at] + run[at + 1 :])
                fold = H(*run[:at], fold, *run[at + 1 :])
            out.append((r[0], own, trees[s][-1][0], top[-1][0], H(proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(docs):
    row = lambda text: merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", row(F.col("text")).alias("leaf"), F.when(tampered, row(F.translate("text", UP, LOW))).alias("claim"))
    got = merkle.climbed(*merkle.manifest(leaves))
    assert got.columns == COLS
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 17}, {"a": 1, "b": 1, None: 1}, {"hot": 290, "z": 16, "é": 1, None: 33, **{f"s{i}": i % 3 + 1 for i in range(40)}}])
def test_against_a_tree_built_by_hand(frame, monkeypatch, sizes):
    monkeypatch.setattr(merkle, "MEET", 2)  # high nodes are met in copies
    r = random.Random(3)
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            k += r.randint(1, 3)
            rows.append((k, source, r.choice(["en", None]), r.choice([None, 5]), r.choice([None, "", "Ab é", "x" * 50_000, "same Text"])))
    r.shuffle(rows)
    docs = frame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert run(docs) == brute(rows)


def test_repeated_rows_null_keys_and_clashing_names(frame):
    rows = [(None, "a", None, None, "T")] * 3 + [(5, "a", "en", 1, "T")] * 20 + [(5, "a", "en", 1, "other")]
    docs = frame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = docs.withColumns({c: F.lit("x") for c in ("tree", "up", "slot", "node", "number", "key", "hash")})
    assert run(clash) == brute(rows)


def test_no_rows(frame):
    assert run(frame([], "doc_id long, source string, lang string, n_chars long, text string")) == []


def test_the_row_limit_of_the_session_comes_back(spark, frame):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    run(frame([(1, "a", None, None, "x"), (2, "a", None, None, "y")], "doc_id long, source string, lang string, n_chars long, text string"))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_the_query_against_its_sql(spark, sf_dir):
    same(queries.QUERIES["op12_merkle"](spark, sf_dir), connect(sf_dir), queries.ORACLES["op12_merkle"])
