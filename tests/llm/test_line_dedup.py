import random

import numpy as np
import pytest

from lineal.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_similarity():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randint(0, len(b)), rng.choice("abc"))
        want, got = 1 - distance(a, b) / max(len(a), len(b), 1), ld.edit_similarity(a, b)
        assert abs(want - got) < 1e-9
        assert all(ld.alike(a, b, x) == (want >= x - 1e-9) for x in (0.5, 0.8, 0.9, 1.0))


@pytest.mark.parametrize("blocks,near", [(3, 1), (5, 3)])
def test_block_keys_meet(blocks, near):
    rng = random.Random(4)
    x = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.sample(range(64), rng.randint(0, near)):
            y[i] ^= np.uint64(1 << b)
    a, b = (ld.block_keys(v.view(np.int64), blocks, near) for v in (x, y))
    assert (a == b).any(axis=1).all() and (a % 2 == 1).all() and len(np.unique(a)) == a.size


def test_lines_of_texts_are_normal_words():
    """Cut as bytes or one by one: the same words, digests and places, for any letters, signs, breaks and empty lines."""
    rng = random.Random(3)
    signs = "abcXYZÄßéÿµªº²³¹½_0123 \t\r\x0b\x0c\x1c\x85\xa0-–—'’.,!œŒИжΣς日ſİı\n\n٣"
    texts = ["", "\n", " \n--\n\n", "a\nb", "== ==\nA  b\tC-d", *("".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(400)), *("".join(rng.choice(signs[:36]) for _ in range(80)) for _ in range(200))]
    want = {(i, p): own for i, t in enumerate(texts) for p, line in enumerate(t.split("\n")) if (own := ld.normal_words(line))}
    got = {}
    for part in ld.cut_lines(texts):
        raw, at = part.buffer.tobytes(), 0
        for text, pos, n, name in zip(part.text.tolist(), part.pos.tolist(), part.sizes.tolist(), part.ids, strict=True):
            words = [raw[a:b] for a, b in zip(part.start[at : at + n].tolist(), part.end[at : at + n].tolist())]
            at += n
            assert words == [ld.word_bytes(w) for w in want[(text, pos)]] and name == ld.form_id(want[(text, pos)])
            got[(text, pos)] = words
    assert got.keys() == want.keys()


def brute(rows):
    occ, first = [], {}
    for k, t in sorted(rows):
        for p, line in enumerate((t or "").split("\n")):
            if own := ld.normal_words(line):
                occ.append((k, p, " ".join(own)))
                first.setdefault(occ[-1][2], len(first))
    forms = list(first)
    up = list(range(len(forms)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(forms)):
        for j in range(i):
            if ld.edit_similarity(forms[i].split(" "), forms[j].split(" ")) >= ld.SIMILARITY:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    head = {}
    for k, p, s in occ:
        head.setdefault(root(first[s]), (k, p))
    gone = {(k, p) for k, p, s in occ if head[root(first[s])] != (k, p)}
    return {k: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone) for k, t in rows}


def test_kept_lines_are_those_of_brute_force(frame):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    base = [[word() for _ in range(rng.randint(1, 60))] for _ in range(30)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                x[rng.randrange(len(x))] = word()
            lines.append(rng.choice([" ".join(x), " ".join(x).upper() + "!", "", "  ", "--"]))
        rows.append((k, "\n".join(lines)))
    # a large family of near copies of one long line
    long = [word() for _ in range(150)]
    for k in range(100, 130):
        x = list(long)
        x[rng.randrange(150)] = word()
        rows.append((k, " ".join(x) + "\n" + f"page {k} of 900 in this book of many pages"))
    rows += [(200, None), (201, ""), (202, "w " * 60_000), (203, "w " * 60_001)]
    df = frame([(k, t, "extra", 1, 7) for k, t in rows], "doc_id long, text string, _k string, n_lines int, _TH int")
    out = ld.dedup_lines(df, sure=ld.SIMILARITY)
    assert out.columns == ["doc_id", "text", "_k", "_TH", "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_repeated_rows_null_keys_and_empty_table(frame):
    line = "one and the same line of words"
    out = ld.dedup_lines(frame([(1, line), (1, line), (2, line), (None, line)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out) == [(False, 1, ""), (False, 1, ""), (False, 2, ""), (True, 0, line)]
    assert ld.dedup_lines(frame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("hot", [0, 100])
def test_edited_short_lines_are_found_by_edit_similarity_alone(frame, monkeypatch, hot):
    """One word in five replaced, dropped or added, in lines of 4 to 60 words; brute force asks for edit similarity only."""
    monkeypatch.setattr(ld, "HOT", hot)
    monkeypatch.setattr(ld, "SPLIT_WORDS", 25)
    rng = random.Random(hot)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 9)
    rows = []
    for k in range(90):
        x = [word() for _ in range(rng.choice([4, 5, 6, 8, 10, 15, 24, 30, 31, 40, 60]))]
        rows.append((2 * k, " ".join(x)))
        for _ in range(max(1, len(x) // 5)):
            at, kind = rng.randrange(len(x)), rng.randrange(3)
            x[at : at + (kind < 2)] = [word()] * (kind != 1)
        rows.append((2 * k + 1, " ".join(x)))
    words = {k: t.split(" ") for k, t in rows}
    up = {k: k for k in words}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in words:
        for j in range(i):
            if 1 - distance(words[i], words[j]) / max(len(words[i]), len(words[j])) >= ld.SIMILARITY:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = {k: root(k) != k for k in words}
    assert sum(want.values()) > 70
    out = ld.dedup_lines(frame(rows, "doc_id long, text string"), sure=ld.SIMILARITY).collect()
    assert {r.doc_id: r.n_dropped == 1 for r in out} == want


def test_marks_of_lines():
    """Fingerprints are the majority of the words' bits, however words are cut; pairs of rare words come first, and repeats differ."""
    rng = random.Random(2)
    marks = ld.LineMarks({"a": 3, "b": 1}, {"c d": 20_001, "e f": 20_002}, 0.8)
    lines = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)] for n in (1, 2, 3, 5, 9, 40, 300, 1200)]
    whole = ld.listed([(0, i, x) for i, x in enumerate(lines)])
    told = [x.to_pylist() for x in marks(whole)]
    fp, pairs, taken, n = told[:4]
    h = ld.Prefixes(whole.buffer)(whole.start, whole.end)
    code = np.array([{"a": 3, "b": 1}.get(w, 0) for x in lines for w in x], np.uint64) << np.uint64(49) | h >> np.uint64(15)
    bits, at = ld._mix(code).tolist(), 0
    for i, own in enumerate(lines):
        hashes = bits[at : at + len(own)]
        at += len(own)
        assert fp[i] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(own)) and n[i] == len(own)
        assert len(pairs[i]) == (min(taken[i] + 1, len(own) - 1) if taken[i] else 0) and len(set(pairs[i])) == len(pairs[i]) and all(p % 2 == 0 for p in pairs[i])
        alone = [x.to_pylist()[0] for x in marks(ld.listed([(0, 0, own)]))]
        assert alone == [x[i] for x in told] == [x.to_pylist()[0] for x in marks(whole.some(np.array([i])))]
    sizes = np.array([len(x) for x in lines])
    assert (marks._fingerprints(code, sizes, np.cumsum(sizes) - sizes, most=7).tolist()) == fp


def test_lines_that_one_edit_parts_are_found(frame):
    """With the parameters of the query: one word replaced, dropped or added, in lines of 5 to 200 words; other lines stay."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for k in range(120):
        x = [word() for _ in range(rng.choice([5, 6, 7, 9, 12, 20, 40, 41, 80, 200]))]
        rows.append((2 * k, " ".join(x)))
        at, kind = rng.randrange(len(x)), rng.randrange(3)
        x[at : at + (kind < 2)] = [word()] * (kind != 1)
        rows.append((2 * k + 1, " ".join(x)))
    words = {k: t.split(" ") for k, t in rows}
    want = {k: k % 2 == 1 and ld.edit_similarity(words[k - 1], words[k]) >= ld.SIMILARITY for k in words}
    assert sum(want.values()) > 110
    out = ld.dedup_lines(frame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_dropped == 1 for r in out} == want


def test_lines_that_share_a_passage_only_do_not_meet(spark, frame):
    """Pairs that many texts hold come last, so a passage in otherwise different lines is no key of theirs."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    passage = " ".join(word() for _ in range(40))
    rows = [(k, " ".join(word() for _ in range(60)) + " " + passage + " " + " ".join(word() for _ in range(60))) for k in range(40)]
    df = frame(rows, "doc_id long, text string")
    words, pairs = ld.ranks_of(df, "text")
    assert len(words) >= 40 and set(pairs) >= {" ".join(x) for x in zip(passage.split(" "), passage.split(" ")[1:])} and min(pairs.values()) > max(words.values())
    lines = ld.materialize(ld._lines(df, "doc_id", "text", ld.SIMILARITY, ld.SURE))
    assert ld.shared_keys(lines).count() == 0
    assert all(r.n_dropped == 0 for r in ld.dedup_lines(df).collect())


@pytest.mark.parametrize("seed,alphabet", [(31, "abcdefghij"), (32, "abc")])
def test_all_links_of_the_query_are_found(frame, seed, alphabet):
    """With the parameters of the query: as many edits as the similarity allows, of each kind, in lines of few or many different words; brute
    force knows no keys."""
    rng = random.Random(seed)
    word = lambda: rng.choice(alphabet) * rng.randint(1, 12)
    rows = []
    for k in range(110):
        x = [word() for _ in range(rng.choice([5, 9, 10, 14, 15, 20, 25, 30, 35, 50, 90]))]
        rows.append((2 * k, " ".join(x)))
        mode, first = rng.randrange(4), len(x)
        for _ in range(first // (4 if mode == 2 else 5)):
            at, kind = rng.randrange(len(x)), mode if mode < 3 else rng.randrange(3)
            x[at : at + (kind < 2)] = [word()] * (kind != 1)
        rows.append((2 * k + 1, " ".join(x)))
    want = brute(rows)
    assert sum(not t for t in want.values()) > 90
    assert {r.doc_id: r.text for r in ld.dedup_lines(frame(rows, "doc_id long, text string")).collect()} == want


def test_counts_of_words_decide_no_link(frame, monkeypatch):
    """Common words, from a sample of texts, order pairs only: the lines that go are the same with any counts, and with none."""
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    rows = []
    for k in range(60):
        x = [rng.choice(words) for _ in range(rng.choice([6, 10, 15, 20, 30, 40]))]
        rows.append((2 * k, " ".join(x)))
        for _ in range(len(x) // 5):
            x[rng.randrange(len(x))] = rng.choice(words)
        rows.append((2 * k + 1, " ".join(x)))
    df, want = frame(rows, "doc_id long, text string"), brute(rows)
    assert sum(not t for t in want.values()) > 50
    for told in (({}, {}), ({w: rng.randrange(20_000) for w in words}, {f"{x} {y}": 20_001 + rng.randrange(12_000) for x in words for y in words[:20]})):
        monkeypatch.setattr(ld, "ranks_of", lambda docs, text, told=told: told)
        assert {r.doc_id: r.text for r in ld.dedup_lines(df).collect()} == want


def test_prefixes_share_pairs():
    """Lines that similarity allows share a pair among the first ones of each, and two with one more of each, repeats or not."""
    rng = random.Random(5)
    marks = ld.LineMarks({"w1": 3, "w2": 1}, {}, 0.8, 0.8)
    one, two = [], []
    while len(one) < 1500:
        own = rng.choice([3, 8, 50, 2000])
        x = [f"w{rng.randrange(own)}" for _ in range(rng.choice([*range(4, 21), 24, 25, 29, 30, 34, 40, 60]))]
        y, mode = list(x), rng.randrange(4)
        for _ in range(rng.randint(1, max(1, len(x) // 4))):
            at, kind = rng.randrange(len(y)), mode if mode < 3 else rng.randrange(3)
            y[at : at + (kind < 2)] = [f"w{rng.randrange(own)}"] * (kind != 1 or len(y) == 1)
        if x != y and ld.alike(x, y, 0.8):
            one.append(x)
            two.append(y)
    a, b = ([c.to_pylist() for c in marks(ld.listed([(0, i, x) for i, x in enumerate(lines)]))] for lines in (one, two))
    for i in range(len(one)):
        assert set(a[1][i][: a[2][i]]) & set(b[1][i][: b[2][i]]) and len(set(a[1][i]) & set(b[1][i])) >= 2
    assert sum(a[2]) < sum(ld.takes(len(x), 0.8, 0.8) for x in one)


def test_pairs_of_families_meet_once(spark, frame, monkeypatch):
    """Families of near copies with one passage and the same other words, shuffled: each pair of different groups that shares keys and may be similar is compared,
    at one of the many keys or a few, and none of one group. Brute force knows every key."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    passage, own, rows = [word() for _ in range(60)], [word() for _ in range(26)], []
    for f in range(6):
        rng.shuffle(own)
        for _ in range(40 if f < 2 else 3):
            x = passage + own
            x[rng.randrange(60)] = word()
            rows.append((len(rows), " ".join(x)))
    df, met, kept = frame(rows, "doc_id long, text string"), [], ld.unlike_pairs

    def watched(rows_, near):
        own = ld.materialize(rows_)
        met.append((own, kept(own, near)))
        return met[0][1]

    monkeypatch.setattr(ld, "unlike_pairs", watched)
    monkeypatch.setattr(ld, "ranks_of", lambda docs, text: ({}, {}))
    assert {r.doc_id: r.text for r in ld.dedup_lines(df).collect()} == brute(rows)
    told, pairs = met[0][0].collect(), {(r.a, r.b) for r in met[0][1].collect()}
    keys = {}
    for r in told:
        keys.setdefault(r.k, []).append(r)
    mask = lambda x: [x[m] % 2**64 for m in ld.MASKS]
    want, places, kept_places = set(), 0, 0
    for own in keys.values():
        for r in own:
            for s in own:
                x, y = r.x, s.x
                edits = ld.allowed(max(x.w, y.w), ld.SIMILARITY)
                if x.u < y.u and x.g != y.g and sum((p ^ q).bit_count() for p, q in zip(mask(x), mask(y))) <= 2 * edits - abs(x.w - y.w):
                    want.add((x.u, y.u))
                    places += 1
                    kept_places += not set(r.earlier) & set(s.earlier)
    assert pairs == want and len(want) > 2000
    assert kept_places < 1.2 * len(want) and places > 5 * len(want)


def test_likely_lines_are_all_that_are_alike():
    """Words and parities rule no similar pair out, and put one out that its number of edits alone would not."""
    rng = random.Random(8)
    marks = ld.LineMarks({}, {})
    pairs = []
    for _ in range(1500):
        x = [f"w{rng.randrange(rng.choice([5, 500]))}" for _ in range(rng.randint(5, 80))]
        y, mode = list(x), rng.randrange(4)
        for _ in range(rng.randint(1, max(1, len(x) // 4))):
            at, kind = rng.randrange(len(y)), mode if mode < 3 else rng.randrange(3)
            y[at : at + (kind < 2)] = [f"v{rng.randrange(500)}"] * (kind != 1 or len(y) == 1)
        pairs.append((x, y))
    pairs.append(([f"a{i}" for i in range(50)], [f"a{i}" for i in range(13, 50)] + [f"b{i}" for i in range(5)]))  # 13 edits at least, of 10
    a, b = ([c.to_pylist() for c in marks(ld.listed([(0, i, x) for i, x in enumerate(lines)]))] for lines in zip(*pairs))
    told = ld.likely(np.array(a[3]), [np.array(m, np.int64) for m in a[4:]], np.array(b[3]), [np.array(m, np.int64) for m in b[4:]], ld.SIMILARITY)
    alike = [ld.alike(x, y, ld.SIMILARITY) for x, y in pairs]
    assert all(t or not s for t, s in zip(told.tolist(), alike)) and sum(alike) > 500
    flips = sum((p ^ q).bit_count() for p, q in zip((c[-1] % 2**64 for c in a[4:]), (c[-1] % 2**64 for c in b[4:])))
    assert not told[-1] and not alike[-1] and flips <= 2 * ld.allowed(50, ld.SIMILARITY)


def test_tables_that_are_read_no_more_are_deleted(frame, monkeypatch):
    """When the lines that go are known, only the lines and their groups are left of the large tables."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    x, made, kept = [word() for _ in range(20)], [], ld.materialize
    rows = [(k, " ".join(x[: k % 20] + [word()] + x[k % 20 :])) for k in range(30)]

    def watched(df, name="table"):
        made.append((name, kept(df, name)))
        return made[-1][1]

    monkeypatch.setattr(ld, "materialize", watched)
    out = ld.dedup_lines(frame(rows, "doc_id long, text string"))
    path = lambda table: table.inputFiles()[0].rsplit("/", 1)[0]
    sc = out.sparkSession.sparkContext
    exists = lambda p: (lambda f: f.getFileSystem(sc._jsc.hadoopConfiguration()).exists(f))(sc._jvm.org.apache.hadoop.fs.Path(p))
    left = sorted(name for name, table in made if name.startswith("line") and table.inputFiles() and exists(path(table)))
    assert {"lines", "line-groups"} <= set(left) and not set(left) & {"line-keys", "line-marked", "line-mixed", "line-pairs", "line-texts", "line-classes", "line-hot"} and left.count("lines") == 1
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_keys_of_a_batch_are_packed(frame, monkeypatch):
    """A batch of lines tells the keys of its forms in one row, each turn's apart, and they are those of LineMarks; rows of lines have none."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = [(k, "\n".join(" ".join(word() for _ in range(rng.choice([1, 5, 20, 60]))) for _ in range(30))) for k in range(30)]
    monkeypatch.setattr(ld, "ranks_of", lambda docs, text: ({}, {}))
    told = ld._lines(frame(rows, "doc_id long, text string"), "doc_id", "text", ld.SIMILARITY, ld.SURE).collect()
    batches = [r for r in told if r.us is not None]
    assert len(told) == 900 and 1 <= len(batches) <= 3
    got = set()
    for r in batches:
        u = np.frombuffer(r.us, np.int64)
        assert len(r.masks) == 32 * len(u) and len(r.ws) == 2 * len(u)
        for turn in range(ld.TURNS):
            k, row = ld.unpack_keys(bytes(r[f"k{turn}"]), turn)
            assert (k * ld.TURNS >> ld.KEY_BITS == turn).all()
            got |= set(zip(k.tolist(), u[row].tolist()))
    lines = [(0, i, x.split(" ")) for i, x in enumerate(y for _, t in rows for y in t.split("\n"))]
    own = ld.listed(lines)
    _, pairs, taken, *_ = (c.to_pylist() for c in ld.LineMarks({}, {})(own))
    want = {(p, int.from_bytes(name[:8], "little", signed=True)) for name, x, n in zip(own.ids, pairs, taken, strict=True) for p in x[:n]}
    assert got == want and len(want) > 5000


@pytest.mark.parametrize("met", [1, 1 << 16])
def test_forms_of_a_key_are_told_whatever_is_looked_at_together(frame, monkeypatch, met):
    """Families under shared keys: `low` is the lowest form that may be similar, by brute force over the rows of each key."""
    monkeypatch.setattr(ld, "MET", met)
    monkeypatch.setattr(ld, "ranks_of", lambda docs, text: ({}, {}))
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(20)] for _ in range(4)]
    lines = {tuple([*x[:3], *(word() if rng.random() < 0.15 else y for y in x[3:])]) for x in base for _ in range(25)}
    lines |= {(*x[:12], *(word() for _ in range(8))) for x in base for _ in range(8)}
    own = ld.listed([(0, i, list(x)) for i, x in enumerate(sorted(lines))])
    _, pairs, taken, w, *masks = (c.to_pylist() for c in ld.LineMarks({}, {})(own))
    keys = {}
    for i, name in enumerate(own.ids):
        for p in pairs[i][: taken[i]]:
            keys.setdefault(p, []).append((int.from_bytes(name[:8], "little", signed=True), i))
    likely = lambda i, j: sum((x[i] % 2**64 ^ x[j] % 2**64).bit_count() for x in masks) <= 2 * ld.allowed(max(w[i], w[j]), ld.SIMILARITY) - abs(w[i] - w[j])
    want = {}
    for k, forms in keys.items():
        forms.sort()
        low, more = {}, set()
        for a, (_, i) in enumerate(forms):
            for b in range(a + 1, len(forms)):
                if likely(i, forms[b][1]):
                    low.setdefault(b, a)
                    if low[b] != a:
                        more |= {a, b}
        for a, (u, _) in enumerate(forms):
            if a in low or a in more:
                want[(k, u)] = (forms[low[a]][0] if a in low else None, len(forms) if a in more else 0)
    df = frame([(i, " ".join(x)) for i, x in enumerate(sorted(lines))], "doc_id long, text string")
    found = ld.shared_keys(ld.materialize(ld._lines(df, "doc_id", "text", ld.SIMILARITY, ld.SURE))).collect()
    assert {(r.k, r.u): (r.low, r.c) for r in found} == want and len(want) > 300
