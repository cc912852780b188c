import hashlib
import random

import numpy as np
import pytest

from lineal.llm import induced, suffix_dedup


def naive_order(strings):
    info, start = [], 0
    for j, s in enumerate(strings):
        info += [(s[i:], j, start + i) for i in range(len(s) + 1)]
        start += len(s) + 1
    info.sort(key=lambda x: ([ord(c) for c in x[0]] + [0], x[1]))
    lcp = [0]
    for (a, _, _), (b, _, _) in zip(info, info[1:]):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        lcp.append(n)
    return [x[2] for x in info], lcp


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("limit", [1, 10**8])
def test_order_and_common_prefixes(monkeypatch, small, limit):
    """With recursion or the in-memory base case, with queues on disk or in memory."""
    monkeypatch.setattr(induced, "SMALL", small)
    monkeypatch.setattr(induced, "QUEUE_BYTES", limit)
    rng = random.Random(small + limit)
    for _ in range(150):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        strings = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20, 40]))) for _ in range(rng.randint(1, 6))]
        strings += [strings[0]] * rng.choice([0, 0, 2])
        text = np.array([ord(c) for s in strings for c in s + "\0"])
        place, lcp = induced.suffix_array(text, 128)
        assert (place.tolist(), lcp.tolist()) == naive_order(strings), strings


def brute(rows, length):
    """{key: (n_bytes, n_removed, spans, kept)} of rows (key, text) with different keys."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                covered[i : i + length] = True
            seen.add(b[i : i + length])
        edge = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        spans = list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist()))
        out[key] = (len(b), int(covered.sum()), spans, np.frombuffer(b, np.uint8)[~covered].tobytes())
    return out


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, [(s.lo, s.hi) for s in r.spans], bytes(r.kept)) for r in df.collect()}


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    rows = [(i, text(40) + " " + shared[rng.randint(0, 50) :] + " " + text(20)) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "short"), (23, "x" * 300), (24, "ab" * 200), (25, "x" * 150), (26, rows[3][1]), (27, "y" * 99), (28, "y" * 100), (29, "y" * 101), (None, rows[4][1]), (30, text(30) * 3)]
    return rows


def test_removed_bytes_are_those_of_brute_force(frame):
    rows = corpus()
    df = frame([(k, t, "kept", 5) for k, t in rows], "doc_id long, text string, kept string, h int")
    assert got(suffix_dedup.repeated_strings(df)) == brute(rows, suffix_dedup.LENGTH)


def test_small_shards_and_blocks_agree(frame, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1)
    df = frame(rows, "doc_id long, text string")
    assert got(suffix_dedup.repeated_strings(df)) == brute(rows, suffix_dedup.LENGTH)
    b = (corpus()[0][1] * 3).encode()
    whole = suffix_dedup.segments(b)
    blobs = [(t or "").encode() for _, t in corpus()] + [b, b""]
    h, text, start, n, twice, at, joined = suffix_dedup.many_segments(blobs)
    for i, own in enumerate(blobs):
        one, mine = suffix_dedup.segments(own), text == i
        assert [x.tolist() for x in one[:3]] == [x[mine].tolist() for x in (h, start, n)] and not (one[3] & ~twice[mine]).any()
        assert all(joined[a : a + 100] == own[s : s + 100] for a, s in zip(at[mine].tolist(), start[mine].tolist()))
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 37)
    cut = suffix_dedup.segments(b)
    spread = lambda s: [h for h, n in zip(s[0].tolist(), s[2].tolist()) for _ in range(n)]
    assert spread(whole) == spread(cut)


def test_repeated_rows_and_empty_table(frame):
    text = "z" + corpus()[0][1]
    out = suffix_dedup.repeated_strings(frame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed > 0) for r in out) == [(1, False), (1, False), (2, True)]
    assert suffix_dedup.repeated_strings(frame([], "doc_id long, text string")).count() == 0


def test_query(spark, tmp_path, frame):
    from lineal.llm import queries

    rows = corpus()
    frame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, 100)
    for r in queries.op1_suffix_dedup(spark, str(tmp_path)).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, len(spans), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("period", [76, 77, 78])
def test_repeats_of_a_string_window_s_own_period(frame, period):
    """A line that stands several times in a row in one document, and nowhere else."""
    rng = random.Random(period)
    line = "".join(rng.choice("abcdefghij ") for _ in range(period - 1)) + "\n"
    rows = [(1, line * 3), (2, "another text " + line[::-1] * 4)]
    want = brute(rows, suffix_dedup.LENGTH)
    assert all(x[1] > 0 for x in want.values())
    assert got(suffix_dedup.repeated_strings(frame(rows, "doc_id long, text string"))) == want


@pytest.mark.parametrize("length", [60, 300])
def test_other_lengths(frame, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(700)
    rows = [(i, text(90) + shared[50 * i :] + text(40)) for i in range(6)] + [(9, "q" * 900), (10, text(20) * 40)]
    want = brute(rows, length)
    assert sum(x[1] > 0 for x in want.values()) >= 7
    assert got(suffix_dedup.repeated_strings(frame(rows, "doc_id long, text string"), length=length)) == want


@pytest.mark.parametrize("hot", [0, 300])
def test_a_phrase_in_every_document(frame, monkeypatch, hot):
    """Names whose different contexts hold more strings than a shard may."""
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", hot)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase = text(170)
    rows = [(i, text(rng.randint(0, 60)) + phrase + text(rng.randint(0, 60))) for i in range(50)]
    rows += [(60, rows[3][1]), (61, rows[4][1][5:]), (62, phrase * 3), (63, "z" * 400), (64, None)]
    df = frame(rows + [(60, rows[3][1])], "doc_id long, text string")
    assert got(suffix_dedup.repeated_strings(df)) == brute(rows, suffix_dedup.LENGTH)


def test_a_shard_beyond_the_queue_s_memory(monkeypatch):
    """With the constants of the query: queues go to disk, and the recursion runs more than once."""
    spilled, depth = [], []
    spill, sort = induced.BulkQueue._spill, induced.suffix_array
    monkeypatch.setattr(induced.BulkQueue, "_spill", lambda self: spilled.append(1) or spill(self))
    monkeypatch.setattr(induced, "suffix_array", lambda *a: depth.append(len(a[0])) or sort(*a))
    rng = np.random.default_rng(1)
    pool = rng.integers(1, 60, 40_000)
    parts = []
    for at in rng.integers(0, 39_000, 34_000):
        parts += [pool[at : at + 170], np.zeros(1, np.int64)]
    text = np.concatenate(parts)
    place, lcp = induced.suffix_array(text, 60)
    assert len(text) * 9 > 3 * induced.QUEUE_BYTES and spilled and len(depth) >= 2
    raw, ends = text.astype(np.uint8).tobytes(), np.nonzero(text == 0)[0]
    assert np.array_equal(np.sort(place), np.arange(len(text)))
    end = ends[np.searchsorted(ends, place)]
    for i in rng.integers(1, len(text), 60_000).tolist():
        a, b = raw[place[i - 1] : end[i - 1]], raw[place[i] : end[i]]
        n = int(lcp[i])
        assert a[:n] == b[:n] and (a < b or (a == b and place[i - 1] < place[i])) and (n == 250 or n == min(len(a), len(b)) or a[n] != b[n])
