import random
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lineal.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@cache
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def checked(rows, docs, window=packing.WINDOW):
    """Holds pieces against documents, a list of (key, text); lengths of the sequences."""
    want, got, seqs = defaultdict(int), defaultdict(int), defaultdict(list)
    for k, text in docs:
        want[k, tuple([*plain(text), packing.END])] += 1
    pieces = defaultdict(list)
    for r in rows:
        assert len(r.ids) == packing.WIDTH * r.length and 0 < r.length <= window
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for k in pieces:  # rows of one key are told apart by their numbers of ids where these differ
        by = defaultdict(list)
        for p in sorted(pieces[k]):
            by[p[2]].append(p)
        for total, own in by.items():
            copies = sum(p[1] for p in own) // total
            assert sum(p[1] for p in own) == copies * total
            if copies == 1:
                assert [p[0] for p in own] == list(np.cumsum([0, *(p[1] for p in own)])[:-1])
                got[k, tuple(i for p in own for i in p[3])] += 1
            else:
                whole = next(x for (key, x) in want if key == k and len(x) == total)
                for start, length, _, ids in own:
                    assert tuple(ids) == whole[start : start + length]
                got[k, whole] += copies
    assert got == want
    lengths = []
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1])
        lengths.append(sum(n for _, n in own))
    small = [n for n in lengths if n != window]
    assert all(n & (n - 1) == 0 for n in small) and len(small) == len(set(small))
    assert sum(lengths) == sum(len(x) * c for (_, x), c in want.items())
    return lengths


ODD = ["a\x1cb", "Σας ΑΣ", "İstanbul é", "x<|endoftext|>y", "á é　日本語 テキスト", "it's don't I'LL 'S", " x", "ﬁ 1234 ½x  ​", "a\x85b \xa0 ÀÉ ß ŒUVRE", "\n \t", "K Å", "e ́x İ", "<|startoftext|> <|endoftext|>", "w" * 300, "end. end, it's. it'; x2! ½? ß: ... a.. ?! l'. 日. œ. _. -."]


def test_ids_are_the_tokenizer_s():
    chunks = packing.Chunks(PATH)
    for text in ODD * 2:
        assert np.frombuffer(chunks.ids(text), "<u4").tolist() == plain(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert np.frombuffer(packing.chunks_of(PATH).ids(text), "<u4").tolist() == plain(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    chunks = packing.Chunks(PATH)
    text = " ".join(f"word{i}" for i in range(60)) + " " + "x" * 100
    assert np.frombuffer(chunks.ids(text), "<u4").tolist() == plain(text)
    assert len(chunks) <= 10 and len(chunks.before) <= 10 and "x" * 100 not in chunks


@pytest.mark.parametrize("parts", [1, 9, 150])
def test_documents_come_back_from_their_pieces(spark, parts):
    r = random.Random(parts)
    docs = [(i, " ".join(r.choice(["some", "words", "of", "Straße", "日本語"]) for _ in range(int(r.expovariate(1 / 60))))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "long " * 30_000), (None, "no key"), *[(1003, "twice")] * 2, *((1010 + i, x) for i, x in enumerate(ODD))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    lengths = checked(packing.pack(df, PATH, open_windows=4).collect(), docs)
    assert lengths.count(packing.WINDOW) == sum(lengths) // packing.WINDOW


def test_best_fit_then_the_fullest_is_filled():
    p = packing.Packer(0, 10, 2)
    ids = lambda n: b"abcd" * n
    p.add("a", 0, ids(6), 6)
    p.add("b", 0, ids(7), 7)  # a second window
    p.add("c", 0, ids(3), 3)  # fits best beside b
    assert [(x[2], x[3], x[4]) for x in p.take()] == [("b", 0, 7), ("c", 0, 3)]
    p.add("d", 0, ids(5), 5)  # opens a window: a has 4 free
    p.add("e", 0, ids(9), 9)  # none has 9 free: a, the fullest, takes 4 and goes; the other 5 fit beside d
    assert [(x[2], x[3], x[4]) for x in p.take()] == [("a", 0, 6), ("e", 0, 4), ("d", 0, 5), ("e", 4, 5)]
    assert p.open == []


def test_sequences_are_padded_but_at_powers_of_two(spark):
    docs = [(i, "one two three " * i) for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH)
    lengths = checked(pieces.collect(), docs)
    made = packing.sequences(pieces).collect()
    assert sorted(r.n_tokens for r in made) == sorted(lengths)
    assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens.bit_count() == 1 else packing.WINDOW) for r in made)
    odd = packing.sequences(pieces.where("length <> 1024"), pad=7).collect()
    for r in odd:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == (r.n_tokens if r.n_tokens.bit_count() == 1 else packing.WINDOW) and (ids[r.n_tokens :] == 7).all()


def test_no_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH).collect() == []
    clash = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, start int, part int")
    assert [(r.doc_id, r.start, r.length) for r in packing.pack(clash, PATH).orderBy("start").collect()] == [(1, 0, 2)]


def test_the_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    import zlib

    rows = queries.QUERIES["op11_packing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ids = np.array([*plain(docs[r.doc_id]), 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_words_ahead_of_a_mark_are_met_without_it():
    """One memory for a word and the word with a mark, without a call for each: ids stay the tokenizer's."""
    chunks = packing.Chunks(PATH)
    asked = []
    chunks.__class__ = type("Told", (packing.Chunks,), {"__missing__": lambda self, c: asked.append(c) or packing.Chunks.__missing__(self, c)})
    text = "word word, Word. (word) word... é; é x.y. a)! 9:"
    assert np.frombuffer(chunks.ids(text), "<u4").tolist() == plain(text)
    assert "word," not in asked and "é;" not in asked and "9:" not in asked and "a)!" in asked and "word..." in asked
