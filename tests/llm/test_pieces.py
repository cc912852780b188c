from collections import Counter
from itertools import product

import numpy as np
import pytest

from lineal.llm import pieces as ps
from lineal.llm.queries import MODEL


@pytest.fixture(scope="module")
def vocabulary():
    return ps.Vocabulary.load(MODEL)


def every(v, unit):
    out = {}

    def go(i, p, acc):
        if i == len(unit):
            out[tuple(acc)] = p
            return
        for n in range(1, len(unit) - i + 1):
            c = v.chances.get(unit[i : i + n])
            if c is None and n == 1:
                c = v.byte_chance ** len(unit[i].encode())
            if c is not None:
                go(i + n, p * c, [*acc, unit[i : i + n]])

    go(0, 1.0, [])
    return out


def exact(v, text):
    """Chances of all segmentations of the whole text after one space, units or no units."""
    return normal(every(v, " " + text))


def by_units(v, text):
    out = {}
    for combo in product(*[every(v, u).items() for u in ps.Lattices(v).units(text)]):
        out[tuple(x for c, _ in combo for x in c)] = np.prod([p for _, p in combo])
    return normal(out)


def normal(out):
    z = sum(out.values())
    return {k: p / z for k, p in out.items()}


def test_draws_follow_the_chances(vocabulary):
    """First draws by chance, second ones among the rest, and inclusion scores that make sums unbiased."""
    text, n = "ab in", 3000
    chance = exact(vocabulary, text)
    lattices, names = ps.Lattices(vocabulary), {i: p for p, i in vocabulary.ids.items()}
    first, pairs, total = Counter(), Counter(), 0.0
    for paths, kappa in (x for s in range(n) for x in ps.sample_texts(lattices, [text], [s * 7919 + 1], 2)):
        found = [tuple(names[i] for i in ids) for ids in ps.piece_ids(lattices, paths)]
        assert len(set(found)) == 2 and paths[0].gumbel >= paths[1].gumbel >= kappa
        for f, p in zip(found, paths):
            assert abs(p.total - np.log(chance[f])) < 1e-4
            total += chance[f] / -np.expm1(-np.exp(p.total - kappa))
        first[found[0]] += 1
        pairs[tuple(found)] += 1
    assert abs(total / n - 1) < 0.03
    top = sorted(chance, key=chance.get)[::-1][:3]
    for a in top:
        assert abs(first[a] / n - chance[a]) < 0.035
        for b in top:
            if a != b:
                assert abs(pairs[(a, b)] / n - chance[a] * chance[b] / (1 - chance[a])) < 0.035


def test_all_segmentations_come_out_once(vocabulary):
    chance = exact(vocabulary, "ab")
    lattices = ps.Lattices(vocabulary)
    ((paths, kappa),) = ps.sample_texts(lattices, ["ab"], [5], len(chance) + 3)
    assert len(paths) == len({tuple(x) for x in ps.piece_ids(lattices, paths)} ) == len(chance) and kappa == -np.inf


def test_batching_changes_nothing(vocabulary):
    texts = ["some words here", "é▁日本 x\n", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "   lead  and trail   "]
    together = ps.sample_texts(ps.Lattices(vocabulary), texts, [1, 2, 3, 4], 2)
    for t, s, (paths, kappa) in zip(texts, [1, 2, 3, 4], together):
        ((alone, k2),) = ps.sample_texts(ps.Lattices(vocabulary), [t], [s], 2)
        assert k2 == kappa and all(np.array_equal(a.log_p, b.log_p) and a.total == b.total for a, b in zip(alone, paths))


def test_round_trip_and_odd_rows(spark, frame):
    texts = [None, "", " ", "a", "  two  spaces ", "tab\tnew\nline\r", "▁ is no space", "日本語 текст 😀👍🏽", "\x00\x7f", "x" * 200_000, "word " * 40_000, "ab", "ab"]
    df = frame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "null key", [1])], "doc_id long, text string, ids array<int>")
    out = ps.decode(ps.encode(df, MODEL, 2), MODEL).collect()
    got = Counter(r.doc_id for r in out)
    assert got[0] == got[1] == 1 and all(got[i] == (1 if t == "\x00\x7f" else 2) for i, t in enumerate(texts) if t) and got[None] == 2
    for r in out:
        assert r.text == ("null key" if r.doc_id is None else texts[r.doc_id] or "") and 0 <= r.inclusion <= 1 and r.log_inclusion > -np.inf
        assert r.inclusion > 0 or len(r.text) > 500
    again = ps.encode(df.repartition(5), MODEL, 2)
    assert sorted(map(str, again.collect())) == sorted(map(str, ps.encode(df, MODEL, 2).collect()))
    assert ps.encode(df.limit(0), MODEL).count() == 0


def test_inclusion_of_long_texts_is_kept_as_logarithm(frame):
    rows = [(1, "ab"), (2, "some words in here"), (3, "some words of a long text " * 2000), (4, None)]
    out = {(r.doc_id, r.sample): r for r in ps.encode(frame(rows, "doc_id long, text string"), MODEL, 2).collect()}
    assert all(np.isfinite(r.log_inclusion) and r.log_inclusion <= 0 and abs(np.exp(r.log_inclusion) - r.inclusion) < 1e-12 for r in out.values())
    assert out[(3, 1)].inclusion == 0 and out[(3, 1)].log_inclusion < -745
    # the threshold is the same for both samples of a text
    assert abs((out[(3, 1)].log_inclusion - out[(3, 1)].log_prob) - (out[(3, 2)].log_inclusion - out[(3, 2)].log_prob)) < 1e-6
    assert out[(4, 1)].log_inclusion == 0


def small_vocabulary(pieces):
    """A vocabulary of few pieces, of chances that fall along the list."""
    ids = {p: i + 256 for i, p in enumerate(pieces)}
    return ps.Vocabulary(ids, {p: 0.3 / (i + 2) for i, p in enumerate(pieces)}, list(range(256)), 0.01, [bytes([i]) for i in range(256)] + [p.encode() for p in pieces])


LONG_PIECES = [" ", "a", "b", " a", "ab", "abab", "a" * 20, "  ", "ab ab", "b\nb"]


@pytest.mark.parametrize("text", ["abab abab", "ab  ab", "b\nb\nb", "é ab", "a" * 22, "aab aba ababab  aabb"])
def test_lattices_hold_every_segmentation(text):
    """Units change nothing: summed chances over whole texts, pieces of more than 16 characters, with inner
    spaces and newlines, are those of an enumeration without units."""
    v = small_vocabulary(LONG_PIECES)
    lattices = ps.Lattices(v)
    assert "".join(lattices.units(text)) == " " + text
    chance = {}
    for s in range(40):
        ((paths, _),) = ps.sample_texts(lattices, [text], [s], 8)
        for p, ids in zip(paths, ps.piece_ids(lattices, paths)):
            assert ps.decode_ids(ids, v.surfaces) == text
            chance[tuple(ids)] = np.exp(p.total)
    if text != "a" * 22:
        whole = every(v, " " + text)
        z, drawn = sum(whole.values()), sorted(chance.values())[::-1]
        assert np.allclose(sorted((p / z for p in whole.values()), reverse=True)[:3], drawn[:3], rtol=1e-4)
    else:
        assert any(256 + LONG_PIECES.index("a" * 20) in k for k in chance)


def test_long_texts_by_enumeration():
    """First and second draws of a text of 21 characters follow the chances of all its segmentations."""
    v, text, n = small_vocabulary([" ", "a", "b", "ab", "abb", " abb"]), "abbaabbaabb abbaabbab", 4000
    chance = exact(v, text)
    lattices, names = ps.Lattices(v), {i: p for p, i in v.ids.items()}
    first, total = Counter(), 0.0
    for paths, kappa in ps.sample_texts(lattices, [text] * n, [s * 104729 + 5 for s in range(n)], 3):
        found = [tuple(names[i] for i in ids) for ids in ps.piece_ids(lattices, paths)]
        assert len(set(found)) == 3 and paths[0].gumbel >= paths[1].gumbel >= paths[2].gumbel >= kappa
        first[found[0]] += 1
        for f, p in zip(found, paths):
            assert abs(p.total - np.log(chance[f])) < 1e-4
            total += chance[f] / ps.inclusions(p.total - kappa)[0]
    assert abs(total / n - 1) < 0.06
    for a in sorted(chance, key=chance.get)[::-1][:4]:
        assert abs(first[a] / n - chance[a]) < 4 * (chance[a] / n) ** 0.5 + 1e-3


def test_indented_code_and_long_words(frame):
    rows = [(i, " " * i + "x" * n + "\n\t" + " " * (n % 11) + "internationalization" * (1 + n // 40)) for i, n in enumerate([1, 8, 15, 16, 17, 40, 120, 500])]
    rows += [(100, "a  internationalization"), (101, "def f():\n        " + "very_long_name_" * 30), (102, "語" * 5000), (103, "ab" * 100_000)]
    got = ps.decode(ps.encode(frame(rows, "doc_id long, text string"), MODEL, 2), MODEL).collect()
    assert all(r.text == dict(rows)[r.doc_id] and np.isfinite(r.log_inclusion) for r in got)
    assert Counter(r.doc_id for r in got) == {k: 1 if k == 102 else 2 for k, _ in rows}  # no piece joins the sign of 102 to another


def test_memory_of_lattices_is_given_back(vocabulary, monkeypatch):
    """Forgetting what was learnt changes no draw."""
    texts = [f"words number {i} of many {i * 7919 % 1000}" for i in range(60)]
    kept = ps.Lattices(vocabulary)
    expected = [[p.total for p in ps.sample_texts(kept, [t], [i], 2)[0][0]] for i, t in enumerate(texts)]
    monkeypatch.setattr(ps, "CHOICES", 10)
    short = ps.Lattices(vocabulary)
    assert [[p.total for p in ps.sample_texts(short, [t], [i], 2)[0][0]] for i, t in enumerate(texts)] == expected
    assert short.known.n < kept.known.n
