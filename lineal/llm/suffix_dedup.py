"""Removal of repeated byte strings by suffix sorting, in shards that equal strings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .induced import CAP, suffix_array

#: Bytes of a repeated string; bytes of the grams whose least hash in a string names its shard.
LENGTH, GRAM = 100, 24
#: Bytes that are suffix-sorted together, about.
SHARD_BYTES = 2_000_000
#: Strings in the different segments of one name from which on they are told apart by hashes of whole strings.
HOT_STRINGS = 1_000_000
#: Documents whose names are counted together, about.
COUNTED = 2_000
#: Strings hashed at once, of very long texts.
_BLOCK = 1 << 20
_NO_KEY = -(1 << 63)
_B = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grams(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of `gram` bytes, from hashes of runs of 1, 2, 4, ... bytes."""
    out, have, part, size = None, 0, b.astype(np.uint64) + np.uint64(1), 1
    n = len(b) - gram + 1
    while True:
        if gram & size:
            piece = part[have : have + n]
            out = piece.copy() if out is None else out * np.uint64(pow(int(_B), size, 2**64)) + piece
            have += size
        if have == gram:
            return _mix(out)
        part = part[:-size] * np.uint64(pow(int(_B), size, 2**64)) + part[size:]
        size *= 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    n = len(x) - width + 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def segments(b: bytes, length: int = LENGTH, gram: int = GRAM):
    """(h, start, n, twice) arrays: each string of `length` bytes is named by the least hash h of its grams; a
    segment is a run of n strings of equal h that begin at start, start + 1, ... Equal strings have equal h.
    twice: the gram comes again within or right after the strings of its first place, so that the segment may hold a string twice."""
    whole = np.frombuffer(b, np.uint8)
    total = len(whole) - length + 1
    width = length - gram + 1
    out = []
    for at in range(0, max(0, total), _BLOCK):
        with np.errstate(over="ignore"):
            grams = _grams(whole[at : at + _BLOCK + length - 1], gram)
        least = _least(grams, width)
        cut = np.concatenate([[0], np.nonzero(least[1:] != least[:-1])[0] + 1])
        # a gram is the least of a string if it is the greatest least of those that hold it
        edge = np.zeros(width - 1, np.uint64)
        greatest = ~_least(~np.concatenate([edge, least, edge]), width)
        chosen = np.nonzero(greatest == grams)[0]
        value = grams[chosen]
        again = np.unique(value[1:][(value[1:] == value[:-1]) & (np.diff(chosen) <= width)])
        out.append((least[cut], cut + at, np.diff(np.append(cut, len(least))), np.isin(least[cut], again) if len(again) else np.zeros(len(cut), bool)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h, start, n, twice = (np.concatenate(c) for c in zip(*out, strict=True))
    return h.view(np.int64), start, n, twice


def many_segments(blobs: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(h, text, start, n, twice, at, joined): segments of many texts at once, which none crosses; text: its number, at: where the segment
    begins in all texts joined."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    joined = b"".join(blobs)
    width, total = length - gram + 1, len(joined) - length + 1
    none = np.zeros(0, np.int64)
    if total <= 0:
        return none, none, none, none, none.astype(bool), none, joined
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(blobs)), sizes)
    with np.errstate(over="ignore"):
        grams = _grams(np.frombuffer(joined, np.uint8), gram)
    least = _least(grams, width)
    place = np.arange(total)
    inside = place <= (ends - length)[own[:total]]
    begins = inside.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (own[1:total] != own[: total - 1])
    at = np.nonzero(begins)[0]
    if not len(at):
        return none, none, none, none, none.astype(bool), none, joined
    n = np.add.reduceat(inside.astype(np.int64), at)
    # a gram is the least of a string if it is the greatest least of those that hold it
    edge = np.zeros(width - 1, np.uint64)
    greatest = ~_least(~np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), width)
    chosen = np.nonzero(greatest == grams)[0]
    value = grams[chosen]
    again = np.unique(value[1:][(value[1:] == value[:-1]) & (np.diff(chosen) <= width) & (own[chosen[1:]] == own[chosen[:-1]])])
    h = least[at]
    return h.view(np.int64), own[at], at - (ends - sizes)[own[at]], n, np.isin(h, again) if len(again) else np.zeros(len(h), bool), at, joined


def _batches(batch, texts: int):
    """Rows of a batch with the text in column `texts` as bytes, in lists of about _BLOCK bytes."""
    some, size = [], 0
    for row in zip(*(batch.column(i).to_pylist() for i in range(texts)), batch.column(texts), strict=True):
        b = row[-1].as_py().encode("utf-8", "surrogatepass")
        some.append((*row[:-1], b))
        size += len(b)
        if size > _BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _segments_of(blobs: list[bytes], length: int):
    """(h, text, start, n, twice, at, joined) of texts; a very long one is cut in blocks of its own."""
    if len(blobs) == 1 and len(blobs[0]) > 2 * _BLOCK:
        h, start, n, twice = segments(blobs[0], length)
        return h, np.zeros(len(h), np.int64), start, n, twice, start, blobs[0]
    return many_segments(blobs, length)


def _parted(rows: list[tuple]):
    """Very long texts alone, the others together."""
    long = [r for r in rows if len(r[-1]) > 2 * _BLOCK]
    short = [r for r in rows if len(r[-1]) <= 2 * _BLOCK]
    return [[r] for r in long] + ([short] if short else [])


#: A segment as it goes through the shuffle.
_ROW = np.dtype([("h", "<i8"), ("d", "<i8"), ("k", "<i8"), ("th", "<i8"), ("start", "<i8"), ("n", "<i4"), ("twice", "?")])


def _copies(base: DataFrame, length: int) -> DataFrame:
    """(h, d, k, th, start, n, twice): segments whose name occurs more than once, or that may hold a string twice; d a hash of the
    segment's bytes.

    Segments go through the shuffle packed, one row for each of a fixed number of parts and batch of texts; a part is that of about COUNTED
    documents. What a batch holds of a name beyond two segments goes past the count, spread over tasks, for such a name is
    repeated in any case. So a hot name costs its part two places a batch.
    """
    parts = max(64, base.count() // COUNTED)

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        held, size = [], 0
        for batch in batches:
            for some in _batches(batch, 2):
                for rows in _parted(some):
                    h, text, start, n, twice, at, joined = _segments_of([r[2] for r in rows], length)
                    view = memoryview(joined)
                    own = np.empty(len(h), _ROW)
                    d = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)), np.uint64, len(at))
                    own["h"], own["d"], own["start"], own["n"], own["twice"] = h, d.view(np.int64), start, n, twice
                    own["k"], own["th"] = (np.array([r[i] for r in rows], np.int64)[text] for i in (0, 1))
                    held.append(own)
                    size += len(h)
                    if size > 300_000:
                        yield from dealt(np.concatenate(held))
                        held, size = [], 0
        if size:
            yield from dealt(np.concatenate(held))

    def dealt(own):
        own = own[np.lexsort((own["h"], own["h"] % parts))]
        h, place = own["h"], np.arange(len(own))
        over = place - np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), place, 0)) > 1
        yield packed(own[~over], own["h"][~over] % parts, False)
        if over.any():
            more = own[over]
            spread = (more["d"] ^ more["k"]) % parts
            order = np.argsort(spread, kind="stable")
            yield packed(more[order], spread[order], True)

    def packed(own, part, many):
        first = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([x.tobytes() for x in np.split(own, first[1:])], pa.binary()), pa.array(np.full(len(first), many))], ["part", "rows", "many"])

    def count(batches):
        held, last = [], None
        for batch in batches:
            for part, rows, many in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(rows, _ROW)
                if many:
                    yield told(own)
                    continue
                if part != last and held:
                    yield told(counted(np.concatenate(held)))
                    held = []
                last = part
                held.append(own)
        if held:
            yield told(counted(np.concatenate(held)))

    def counted(own):
        own = own[np.argsort(own["h"], kind="stable")]
        first = np.nonzero(np.concatenate([[True], own["h"][1:] != own["h"][:-1]]))[0]
        size = np.diff(np.append(first, len(own)))
        return own[np.repeat((size > 1) | np.logical_or.reduceat(own["twice"], first), size)]

    def told(own):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(own[c]).astype(np.int64 if c == "n" else own[c].dtype)) for c in _ROW.names], list(_ROW.names))

    out = base.mapInArrow(run, "part long, rows binary, many boolean").repartition("part").sortWithinPartitions("part")
    return out.mapInArrow(count, "h long, d long, k long, th long, start long, n long, twice boolean")


def _sort_shard(rows, length: int) -> pa.RecordBatch:
    """Suffix-sort segments of whole classes; for each, which of its strings also begin earlier."""
    h, d, k, th, start, blobs = rows
    sizes = np.array([len(x) for x in blobs], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.zeros(int(ends[-1]), np.int32)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int32) + 1
    place, lcp = suffix_array(text, 257, max(CAP, length))
    # suffixes that share `length` bytes with their neighbours form groups; the earliest string of each leads
    group = np.cumsum(lcp < length)
    alike = np.nonzero(lcp >= length)[0]
    members = np.union1d(alike, alike - 1)
    later = np.zeros(len(text), bool)
    if len(members):
        at = place[members].astype(np.int64)
        own = np.searchsorted(ends, at, side="right")
        key, first = np.asarray(k, np.int64)[own], np.asarray(start, np.int64)[own] + at - begins[own]
        order = np.lexsort((first, key, group[members]))
        g, key, first, at = group[members][order], key[order], first[order], at[order]
        lead = np.concatenate([[True], g[1:] != g[:-1]])
        # the same string of the same place (equal keys and texts) is not earlier
        head = np.maximum.accumulate(np.where(lead, np.arange(len(g)), 0))
        later[at] = (key != key[head]) | (first != first[head])
    flags = [np.packbits(later[b : b + s - length + 1]).tobytes() if later[b : b + s].any() else None for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(th, pa.int64()), pa.array(start, pa.int64()), pa.array(flags, pa.binary())], ["h", "d", "fk", "fth", "fstart", "later"])


def repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, text, n_bytes, n_removed, spans array<struct<lo, hi>>, kept binary): each text as UTF-8 without
    every byte that a string of `length` bytes covers which also begins earlier: at a smaller key, or earlier
    in the same document. Overlaps count; strings are judged on the input; none crosses documents.

    1. Every string is named by the least hash of its grams; runs of strings of one name are segments. Equal
       strings have equal names. Names that occur once in the corpus are settled by a count.
    2. Copies of a segment (equal name and bytes) are one class, held by its earliest copy. All but the first copy go. A name with
       one class that holds no string twice is settled by that.
    3. Classes of the other names are dealt by name into shards of about SHARD_BYTES, and each shard's bytes are
       suffix-sorted by external induced sorting; runs of suffixes with a common prefix of `length` are equal strings, the
       earliest leads. The classes of a hot name (more than HOT_STRINGS strings in them) would not fit a shard: their strings are grouped
       by 128 bits of hashes, each group's earliest leads.
    4. Flags go back to all copies and are gathered per document.

    Null texts are empty; a null key comes before all others. Rows that share key and text are one document (each
    row is judged alike); rows that share the key alone compare by place, equal places neither removing the
    other. An empty table stays so. No text or group passes through one task: a document's text and segments meet
    in one row, a name's classes in one shard, and no shard is larger than SHARD_BYTES and a name's HOT_STRINGS strings.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("k"), F.xxhash64(whole).alias("th"), whole.alias("t"))
    copies = materialize(_copies(base, length), "segments")
    first = F.min(F.struct("k", "start", "th")).alias("f")
    classes = materialize(copies.groupBy("h", "d").agg(first, F.min("n").alias("n"), F.max("twice").alias("twice")), "segment-classes")
    per = classes.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("t"), F.sum("n").alias("s")).where("c > 1 or t")
    unsettled = classes.join(per.select("h", (F.col("s") > HOT_STRINGS).alias("hot")), "h")
    wanted = unsettled.groupBy(F.col("f.k").alias("k"), F.col("f.th").alias("th")).agg(F.collect_list(F.struct("h", "d", "f.start", "n", "hot")).alias("want"))
    held = materialize(base.join(wanted, ["k", "th"]).select("k", "th", "t", "want").mapInArrow(_cutter(length), _CUT), "segment-bytes")

    dealt = held.where("not hot").drop("hot").repartition("h").sortWithinPartitions("h", "d")

    def sort(batches):
        rows, size, last, seen = [], 0, None, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > SHARD_BYTES and row[0] != last:
                    yield _sort_shard(list(zip(*rows, strict=True)), length)
                    rows, size = [], 0
                last = row[0]
                if row[:2] == seen:
                    continue  # repeated rows of one document
                seen = row[:2]
                rows.append(row)
                size += len(row[5])
        if rows:
            yield _sort_shard(list(zip(*rows, strict=True)), length)

    told = dealt.mapInArrow(sort, "h long, d long, fk long, fth long, fstart long, later binary").select("h", "d", "later")
    told = told.unionByName(_hot_flags(held.where("hot"), length))
    leads = (F.col("k") == F.col("f.k")) & (F.col("start") == F.col("f.start"))
    # a copy other than the first begins later with all its strings
    named = classes.select("h", "d", "f").join(told, ["h", "d"], "left")
    marks = copies.join(named, ["h", "d"]).select("k", "th", F.col("start").cast("int").alias("s"), F.col("n").cast("int").alias("n"), F.when(leads, F.coalesce("later", F.lit(b""))).alias("later")).where("later is null or length(later) > 0")
    per = marks.groupBy("k", "th").agg(F.collect_list(F.struct("s", "n", "later")).alias("marks"))
    both = base.join(per, ["k", "th"], "left").select("k", "t", "marks")

    def remove(batches):
        for b in batches:
            out, size = [], 0
            for k, t, m in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                own = t.as_py().encode("utf-8", "surrogatepass")
                spans, kept = strip(own, m or [], length)
                out.append((None if k == _NO_KEY else k, len(own), len(own) - len(kept), [{"lo": int(x), "hi": int(y)} for x, y in spans], kept))
                size += len(own)
                if size > 8_000_000:
                    yield done(out)
                    out, size = [], 0
            if out:
                yield done(out)

    def done(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "n_bytes", "n_removed", "spans", "kept"])

    return both.mapInArrow(remove, "key long, n_bytes long, n_removed long, spans array<struct<lo: long, hi: long>>, kept binary").withColumnRenamed("key", key)


_CUT = "h long, d long, k long, th long, start long, s binary, hot boolean"


def _cutter(length: int):
    """Rows (k, th, t, want) to the bytes of the wanted segments."""

    def cut(batches):
        for b in batches:
            rows, size = [], 0
            for k, th, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                own = t.as_py().encode("utf-8", "surrogatepass")
                for w in want:
                    rows.append((w["h"], w["d"], k, th, w["start"], own[w["start"] : w["start"] + w["n"] + length - 1], w["hot"]))
                    size += len(rows[-1][5])
                if size > 8_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return cut


def _hot_flags(held: DataFrame, length: int) -> DataFrame:
    """(h, d, later) of segments of hot names: each string's hash is a row, and all but a hash's earliest are flagged. Minima combine
    map-side, whatever the number of strings of a name."""

    def strings(batches):
        one, two = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for b in batches:
            for h, d, k, start, s in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True):
                n = len(s) - length + 1
                cuts = [s[i : i + length] for i in range(n)]
                cols = [np.full(n, x, np.int64) for x in (h, d, k)] + [np.arange(start, start + n)] + [np.array([f(c) for c in cuts], np.uint64).view(np.int64) for f in (one, two)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, np.arange(n, dtype=np.int32))], ["h", "d", "k", "at", "x", "y", "i"])

    every = held.mapInArrow(strings, "h long, d long, k long, at long, x long, y long, i int")
    # strings of one place (equal keys and different texts) lead together
    places = every.groupBy("x", "y", "k", "at").agg(F.collect_set(F.struct("h", "d", "i")).alias("own"))
    leads = places.groupBy("x", "y").agg(F.min_by("own", F.struct("k", "at")).alias("own")).select(F.explode("own").alias("o")).select("o.*")
    told = leads.groupBy("h", "d").agg(F.collect_list("i").alias("own"))
    classes = held.select("h", "d", (F.length("s") - length + 1).alias("n")).dropDuplicates(["h", "d"])

    def flags(batches):
        for b in batches:
            out = []
            for n, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                bits = np.ones(n, bool)
                bits[own or []] = False
                out.append(np.packbits(bits).tobytes() if bits.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["h", "d", "later"])

    return classes.join(told, ["h", "d"], "left").select("h", "d", "n", "own").mapInArrow(flags, "h long, d long, later binary")


def strip(own: bytes, marks: list[dict], length: int):
    """(spans, kept): runs of bytes that marked strings cover, and the bytes left."""
    if not marks:
        return np.zeros((0, 2), np.int64), own
    edge = np.zeros(len(own) + 1, np.int64)
    for m in marks:
        if m["later"] is None:
            edge[m["s"]] += 1
            edge[m["s"] + m["n"] + length - 1] -= 1
        else:
            at = m["s"] + np.nonzero(np.unpackbits(np.frombuffer(m["later"], np.uint8))[: m["n"]])[0]
            edge[at] += 1
            edge[at + length] -= 1
    covered = np.cumsum(edge)[:-1] > 0
    turn = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
    spans = np.stack([np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]], axis=1)
    return spans, np.frombuffer(own, np.uint8)[~covered].tobytes()


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["h", "d", "k", "th", "start", "s", "hot"])
