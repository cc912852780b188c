"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD, components, materialize, unused

_LOWER = str.maketrans(UPPER, LOWER)
_words = re.compile(WORD).findall
#: Shingles hashed before their bits are counted; bounds the memory of very long texts.
_BLOCK = 50_000


#: Sketches of a text besides its fingerprint, shingles that one is made of at least, and the likeness that they are spread for.
SKETCHES, THIN, SPREAD = 8, 3, 0.8
#: Bits by which complete fingerprints of texts with that likeness differ at most: 10 on average, this is four deviations above.
FAR = 22
#: Texts under one sketch that are compared each with each; of more, each with two of them.
EACH = 8
_ODDS = np.array([2 * int(x) + 1 for x in np.random.default_rng(5).integers(1 << 62, size=SKETCHES)], np.uint64)


def _hashes(text: str | None, shingle: int, seed: int):
    """XXH64 of a text's word shingles, repeats included, in arrays of bounded length; nothing for no words."""
    words = [w.encode() for w in _words((text or "").translate(_LOWER))]
    digest = xxhash.xxh64_intdigest
    if words and len(words) < shingle:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    shifted = [words[i:] for i in range(shingle)]
    for at in range(0, len(words) - shingle + 1, _BLOCK):
        yield np.array([digest(b" ".join(x), seed) for x in zip(*(s[at : at + _BLOCK] for s in shifted))], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(counts: np.ndarray, n) -> np.ndarray:
    return np.packbits(counts * 2 > n, axis=-1, bitorder="little").view(np.uint64)


def sketches64(text: str | None, shingle: int, seed: int = 42) -> tuple[int, list[int]]:
    """(fingerprint, sketches): simhash64 of a text, and hashes of the simhashes of small samples of its different shingles.

    A sample takes the shingles whose mixed hash ends in so many zero bits that about THIN to 2 * THIN of them are left, whatever the text's length; so
    two texts of likeness x have one sample equal with a chance of about x to the power of its size, and one of SKETCHES nearly always. As lengths of
    likely pairs may fall on either side of a step in the number of bits, a text near one is sampled on both. No words: no sketches.
    """
    parts = list(_hashes(text, shingle, seed))
    if not parts:
        return 0, []
    every = np.concatenate(parts)
    counts = sum(_bits(every[i : i + _BLOCK]).sum(axis=0, dtype=np.int64) for i in range(0, len(every), _BLOCK))
    fp = int(_majority(counts, len(every))[0])
    own, out = np.unique(every), []
    steps = {max(0, int(np.log2(max(1.0, share * len(own) / THIN)))) for share in (1.0, SPREAD)}
    for step in steps:
        for j in range(SKETCHES if step else 1):
            mixed = own * _ODDS[j]
            some = own[(mixed >> np.uint64(64 - step)) == 0] if step else own
            if len(some):
                print_ = int(_majority(_bits(some).sum(axis=0, dtype=np.int64), len(some))[0])
                out.append(xxhash.xxh64_intdigest(b"%d %d %d" % (step, j, print_), seed))
    return fp, out


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; null or wordless: 0.

    A-Z are lower-cased; fewer words than a shingle give one shingle of them all. A bit is 1 if it is set
    in over half the shingles' XXH64 values.
    """
    counts, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(text, shingle, seed):
        counts += _bits(hashes).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(_majority(counts, n)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, th, fp): th a hash of the text, fp simhash64 of the whole text, its 64 bits as a signed long. One pass, no shuffle."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash64(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["key", "th", "fp"])

    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("t")).mapInArrow(run, "key long, th long, fp long")


def radii(distance: int, segments: int) -> list[int]:
    """Radius of each segment's ball: if two fingerprints differ in at most `distance` bits, in some
    segment they differ in at most its radius (the radii plus one add up to distance plus one)."""
    base, more = divmod(distance + 1, segments)
    return [base + (i < more) - 1 for i in range(segments)]


def hamming_links(fps: DataFrame, distance: int = 2, segments: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of distinct values of fps.fp that differ in at most `distance` bits.

    Multi-index hashing: the 64 bits are cut into segments; each fingerprint is filed under each segment's
    value, and looked up under every value in a small Hamming ball around its own. Of two values that
    differ, the one lookup that clears bits and sets others is made from both sides only where the number
    of set and cleared bits is the same; otherwise from the side with fewer set bits. Candidates are
    verified on all bits. With the default (two segments, radii 1 and 0) a fingerprint makes 18 lookups on
    average. Keys have 64/segments bits, so a bucket holds few values until the corpus nears 2^(64/segments)
    fingerprints; more segments than distance + 1 are refused.
    """
    if not 1 <= segments <= distance + 1:
        raise ValueError("segments must be between 1 and distance + 1")
    distinct = fps.select("fp").distinct()
    cuts = [64 * i // segments for i in range(segments + 1)]
    seg = [F.shiftrightunsigned("fp", cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1 if segments > 1 else -1) for i in range(segments)]
    tables = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("s"), x.alias("v")) for i, x in enumerate(seg)))).alias("e")).select("fp", "e.s", "e.v")

    def ball(i: int):
        """Values in the ball of segment i that have no fewer set bits than fp's own value has."""
        own, width = seg[i], cuts[i + 1] - cuts[i]
        masks = [sum(1 << b for b in c) for r in range(1, radii(distance, segments)[i] + 1) for c in combinations(range(width), r)]
        if not masks:
            return F.array(F.struct(F.lit(i).alias("s"), own.alias("v")))
        masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks)).cast("array<long>")
        near = F.filter(F.transform(masks, lambda m: own.bitwiseXOR(m)), lambda x: F.bit_count(x) >= F.bit_count(own))
        return F.transform(F.concat(F.array(own), near), lambda x: F.struct(F.lit(i).alias("s"), x.alias("v")))

    probes = distinct.select(F.col("fp").alias("p"), F.explode(F.flatten(F.array(*(ball(i) for i in range(segments))))).alias("e")).select("p", "e.s", "e.v")
    hits = probes.join(tables, ["s", "v"]).where((F.col("p") != F.col("fp")) & (F.bit_count(F.col("p").bitwiseXOR(F.col("fp"))) <= distance))
    return hits.select(F.least("p", "fp").alias("a"), F.greatest("p", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, segments: int = 2) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links of at most
    `distance` differing bits, the row's own included.

    Equal fingerprints are one class, so copies cost one link search; wordless and null texts share
    fingerprint 0 and are linked like any other. Repeated rows and equal keys stay rows; a null key keeps
    its row and is never a component's name unless all its group's keys are null. An empty table stays so.
    """
    fps = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    groups = components(hamming_links(fps, distance, segments))
    classes = fps.groupBy("fp").agg(F.min("key").alias("low"))
    named = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(lows, "component").select("fp", "component_id")
    return fps.join(of, "fp").select(F.col("key").alias(key), "fp", "component_id")


def shingles(text: str | None, shingle: int) -> set[str]:
    """The different word shingles of a text; of fewer words, the one of them all; of none, none."""
    words = _words((text or "").translate(_LOWER))
    return {" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def likeness(a: str | None, b: str | None, shingle: int) -> float:
    """Jaccard likeness of two texts' shingles; 1 for two without words."""
    x, y = shingles(a, shingle), shingles(b, shingle)
    return len(x & y) / len(x | y) if x or y else 1.0


def sketched(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, th, fp, sk): fingerprints() with the sketches of each text. One pass, no shuffle."""

    def run(batches):
        for b in batches:
            made = [sketches64(t.as_py(), shingle) for t in b.column(2)]
            fp = np.array([m[0] for m in made], np.uint64).view(np.int64)
            sk = [np.array(m[1], np.uint64).view(np.int64) for m in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp), pa.array(sk, pa.list_(pa.int64()))], ["key", "th", "fp", "sk"])

    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("t")).mapInArrow(run, "key long, th long, fp long, sk array<long>")


def candidates(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """(x, y): pairs of texts (node, fp, sk) that may be alike: those whose fingerprints differ in `distance` bits at most, by multi-index hashing, and
    those that share a sketch and whose complete fingerprints differ in FAR bits at most. Under a sketch of more than EACH texts each is paired with two
    of them, chosen by hash, other ones under each sketch; texts with one fingerprint with the first of them and the next."""
    line = Window.partitionBy("fp", F.pmod("node", F.lit(64))).orderBy("node")
    firsts = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    links = hamming_links(nodes, distance, segments)
    across = links.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    several = nodes.join(firsts, "fp").where("node <> first")
    within = several.select(F.col("first").alias("x"), F.col("node").alias("y")).unionByName(several.select(F.lag("node").over(line).alias("x"), F.col("node").alias("y")).where("x is not null"))

    keys = nodes.select("node", "fp", F.explode("sk").alias("s"))
    mark = F.xxhash64("node", "s")
    one = F.struct(mark.alias("m"), F.col("node").alias("n"), F.col("fp").alias("f"))
    groups = keys.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min(one).alias("low"), F.max(one).alias("high")).where("c > 1")
    met = keys.join(groups, "s")
    few = met.where(F.col("c") <= EACH).select("s", "node", "fp")
    other = few.select("s", F.col("node").alias("n"), F.col("fp").alias("f"))
    each = few.join(other, "s").where("node < n").select("node", "fp", "n", "f")
    stars = met.where(F.col("c") > EACH).select("node", "fp", F.explode(F.array("low", "high")).alias("e")).select("node", "fp", "e.n", "e.f").where("node <> n")
    near = each.unionByName(stars).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("f"))) <= FAR).select(F.col("node").alias("x"), F.col("n").alias("y"))
    every = across.unionByName(within).unionByName(near)
    return every.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = 2, segments: int = 2) -> DataFrame:
    """The rows of docs that stand for their near-duplicate group: one document of each stays, that with the
    smallest key, null keys last, and of that key the one with the smallest text hash. Rows that share key and text are one
    document and all stay.

    Different texts are linked if `similarity` or more of their shingles are common (Jaccard). Pairs to be compared are those of candidates(): by
    fingerprints a few bits apart, which find the likest, and by sketches, which find nearly all of 0.8 and more. Texts without words are alike. Exact copies are one class and cost one search. An empty table stays so.
    """
    fps = materialize(sketched(docs, key, text, shingle), "fingerprints")
    order = F.struct(F.col("key").isNull().alias("n"), "key", "th")
    nodes = fps.groupBy("fp", "th").agg(F.min(order).alias("low"), F.first("sk").alias("sk")).withColumn("node", F.xxhash64("fp", "th"))
    nodes = materialize(nodes, "texts-of-fingerprints")
    pairs = materialize(candidates(nodes, distance, segments), "near-texts")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct().join(nodes.select("node", "low"), "node")
    source = docs.select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    texts = materialize(wanted.join(source, F.col("low.key").eqNullSafe(F.col("k")) & (F.col("low.th") == F.col("h"))).select("node", "t").dropDuplicates(["node"]), "near-texts")

    @F.pandas_udf("boolean")
    def alike(a, b):
        import pandas as pd

        return pd.Series([likeness(x, y, shingle) >= similarity - 1e-12 for x, y in zip(a, b, strict=True)], dtype="bool")

    told = pairs.join(texts.select(F.col("node").alias("x"), F.col("t").alias("tx")), "x").join(texts.select(F.col("node").alias("y"), F.col("t").alias("ty")), "y")
    groups = components(told.where(alike("tx", "ty")).select("x", "y"), "x", "y").withColumnRenamed("node", "u")
    grouped = nodes.join(groups, F.col("node") == F.col("u"), "left").groupBy(F.coalesce("component", "node").alias("g")).agg(F.min("low").alias("low"))
    own, k, h = unused(docs.columns, "_own", "_k", "_h")
    keep = grouped.select(F.col("low.key").alias(k), F.col("low.th").alias(h))
    return docs.withColumn(own, F.xxhash64(text)).join(keep, F.col(key).cast("long").eqNullSafe(F.col(k)) & (F.col(own) == F.col(h)), "left_semi").drop(own)
