import hashlib
import random
import re

import pytest

from lineal.llm import spotsigs as ss

ANCHORS = ["the", "of", "a"]


def signatures(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return set()
    content = [w for w in words if w not in ANCHORS]
    out = {("", *content[: ss.CHAIN])}
    n = 0
    for w in words:
        if w in ANCHORS:
            out.add((w, *content[n : n + ss.CHAIN]))
        else:
            n += 1
    return out


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def texts():
    rng = random.Random(2)
    word = lambda: rng.choice(ANCHORS) if rng.random() < 0.4 else "".join(rng.choice("xyzé") for _ in range(rng.randint(1, 4)))
    rows = [(i * 3, " ".join(word() for _ in range(rng.randint(0, 80)))) for i in range(60)]
    return rows + [(1000, None), (1001, ""), (1002, "?!"), (1003, rows[5][1]), (1004, rows[5][1]), (1005, "the"), (1006, "é𝄞" * 11), (-5, "of old")]


@pytest.mark.parametrize("per", [3, 1000])
def test_edited_texts(frame, monkeypatch, per):
    monkeypatch.setattr(ss, "PER_RANGE", per)
    rows = texts()
    df = frame([(k, t, 1) for k, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in ss.edited_fingerprints(df, anchors=ANCHORS).collect()}
    order = sorted((k, t or "") for k, t in rows)
    assert len(got) == len(rows)
    by_text = {}
    for i, (k, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r.near_edited - likeness(signatures(t), signatures(e))) < 1e-12
        assert abs(r.near_next - likeness(signatures(t), signatures(nxt))) < 1e-12
        by_text.setdefault(t, set()).add(r.fingerprint)
        by_text.setdefault(e, set()).add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_similar_pairs(frame):
    rng = random.Random(7)
    rows = []
    for i in range(8):
        base = [rng.choice(ANCHORS) if j % 2 else f"w{rng.randint(0, 5000)}" for j in range(100)]
        for j in range(4):
            x = list(base)
            for _ in range(j):
                x[rng.randrange(0, 100, 2)] = "new"
            rows.append((i * 10 + j, " ".join(x)))
    members, pairs = ss.similar_groups(frame(rows, "doc_id long, text string"), anchors=ANCHORS)
    names = {r.doc_id: r["class"] for r in members.collect()}
    sets = {k: frozenset(signatures(t)) for k, t in rows}
    want = {tuple(sorted((names[a], names[b]))) for a in sets for b in sets if sets[a] != sets[b] and likeness(sets[a], sets[b]) >= ss.SIMILARITY}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def test_anchors_and_small_tables(frame):
    df = frame([(1, "The of the"), (2, "of THE x")], "doc_id long, text string")
    assert ss.common_words(df, n=2) == ["the", "of"]
    one = ss.edited_fingerprints(frame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert ss.edited_fingerprints(frame([], "doc_id long, text string")).count() == 0
    two = ss.edited_fingerprints(frame([(1, "ab"), (1, "ab"), (None, "cd")], "doc_id long, text string")).collect()
    assert len(two) == 3
