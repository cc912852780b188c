"""SpotSigs document fingerprints, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize

#: Common words taken as anchors, content words in a chain.
ANCHORS, CHAIN = 48, 3
#: Documents in one range of keys, about; ranges at most (their bounds pass through the driver).
PER_RANGE, MAX_RANGES = 1_000, 50_000
SIMILARITY = 0.8
_WORDS = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORDS), F.lit(0))


def common_words(docs: DataFrame, text: str = "text", n: int = ANCHORS) -> list[str]:
    """The n most frequent words of all documents, ties by code point: n short rows on the driver."""
    counts = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return [r.w for r in counts.orderBy(F.desc("c"), "w").limit(n).collect()]


def with_signatures(df: DataFrame, text: str, out: str, anchors: list[str], chain: int = CHAIN) -> DataFrame:
    """df with the sorted set of its text's spot signatures, as hashes: each anchor (and the text's
    beginning) with the next `chain` words that aren't anchors; near the end the chain may be shorter. A text
    without words has an empty set."""
    anchor = (lambda x: x.isin(*anchors)) if anchors else (lambda x: F.lit(False))
    w, c, p = (f"_{out}_{x}" for x in "wcp")
    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumns({c: F.filter(w, lambda x: ~anchor(x)), p: F.array_remove(F.transform(w, lambda x, i: F.when(anchor(x), i).otherwise(-1)), -1)})

    def signature(at, k):
        # before the anchor at place `at`, the k-th, stand at - k content words
        return F.xxhash64(F.get(w, at), *(F.get(c, at - k + j) for j in range(chain)))

    first = F.xxhash64(F.lit(""), *(F.get(c, F.lit(j)) for j in range(chain)))
    every = F.concat(F.array(first), F.transform(p, signature))
    found = F.when(F.size(w) > 0, F.array_sort(F.array_distinct(every))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, found).drop(w, c, p)


def name_of(signatures: str) -> Column:
    """A set's name: its size and 128 bits of hashes over its sorted members."""
    return F.concat_ws("-", F.size(signatures), F.lower(F.lpad(F.hex(F.xxhash64(signatures)), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(1), signatures)), 16, "0")))


def jaccard(a: str, b: str) -> Column:
    """Likeness of two sets, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """docs dealt by ranges of the key so that lead() over a window by (_range) sees each row's successor.

    Keys are cut into ranges by approximate percentiles; a row that opens a range (null keys open the
    first) is copied, with _guest 1, to the end of the range before, and that of the first range to the end of
    the last. So one shuffle by range and a window within ranges are all. `columns` are added as _<name>.
    """
    n = docs.count()
    ranges = min(MAX_RANGES, max(1, n // PER_RANGE))
    cuts = []
    if ranges > 1:
        share = [i / ranges for i in range(1, ranges)]
        cuts = sorted({x for x in docs.agg(F.percentile_approx(key, share, 100_000)).first()[0] or () if x is not None})
    place = F.when(F.col(key).isNull() | F.lit(not cuts), 0).otherwise(_bisect(F.col(key).cast("long"), cuts))
    rows = docs.withColumns({"_range": place, **{f"_{k}": v for k, v in columns.items()}})
    opens = docs.select(place.alias("_range"), F.col(key).alias("_key")).groupBy("_range").agg(F.min("_key").alias("_first"), F.max(F.col("_key").isNull()).alias("_null"))
    opens = opens.withColumn("_first", F.when(~F.col("_null"), F.col("_first"))).drop("_null")  # a null key opens its range
    line = Window.orderBy("_range")  # at most MAX_RANGES rows
    last = F.max("_range").over(Window.partitionBy())
    opens = opens.select(F.col("_range").alias("_own"), "_first", F.coalesce(F.lag("_range").over(line), last).alias("_before"))
    marked = rows.join(F.broadcast(opens), (F.col("_range") == F.col("_own")) & F.col(key).eqNullSafe(F.col("_first")), "left")
    here = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")))
    spread = F.when(F.col("_own").isNull(), here).otherwise(F.concat(here, F.array(F.struct(F.col("_before").alias("r"), F.lit(1).alias("g")))))
    return marked.withColumn("_to", F.explode(spread)).withColumns({"_range": F.col("_to.r"), "_guest": F.col("_to.g")}).drop("_to", "_own", "_first", "_before").repartition("_range")


def _bisect(x: Column, cuts: list) -> Column:
    """Number of cuts at or below x."""
    if not cuts:
        return F.lit(0)
    table = F.array(*(F.lit(int(c)) for c in cuts))
    jumps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))

    def step(at, jump):
        to = at + jump
        return F.when((to <= len(cuts)) & (F.get(table, to - 1) <= x), to).otherwise(at)

    return F.aggregate(jumps, F.lit(0), step)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] | None = None) -> DataFrame:
    """(key, fp, signatures): the set of spot signatures of each whole text, and its name."""
    anchors = common_words(docs, text) if anchors is None else anchors
    return with_signatures(docs.select(F.col(key), F.col(text)), text, "signatures", anchors).select(key, name_of("signatures").alias("fp"), "signatures")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: list[str] | None = None) -> DataFrame:
    """Each document against its edited text and the next document.

    Edited: the last floor(n/2) code points of a text are replaced by the first as many (or all) of the next
    document's, by rising key; after the last comes the first. (key, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next), the last two the Jaccard likeness of signature sets.
    Null texts are empty texts; two without words are alike by 1; repeated rows and equal keys are documents
    of their own; a single document is its own next; an empty table gives an empty result.
    """
    anchors = common_words(docs, text) if anchors is None else anchors
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = with_signatures(with_next(base, key, {"tie": F.xxhash64("t")}), "t", "s", anchors)
    order = Window.partitionBy("_range").orderBy("_guest", F.col(key).asc_nulls_first(), "_tie", F.length("t"))
    seen = dealt.withColumns({"t2": F.lead("t").over(order), "s2": F.lead("s").over(order)}).where("_guest = 0")
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    seen = seen.withColumns({"n": n, "e": F.concat(F.substring("t", F.lit(1), n - half), F.substring("t2", F.lit(1), half))})
    told = with_signatures(seen, "e", "es", anchors)
    return told.select(key, F.col("n").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), name_of("s").alias("fingerprint"), name_of("es").alias("edited_fingerprint"), jaccard("s", "es").alias("near_edited"), jaccard("s", "s2").alias("near_next"))


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, anchors: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (key, class, component) gives each document's signature set and connected
    group; pairs (a, b, likeness) are all pairs of different sets with a Jaccard likeness of `similarity`
    or more.

    Equal sets are one class. Sets are partitioned by length, each partition's bounds 1/similarity apart, so that
    partners are in the same or the next one. Two sets of the likeness share a member among the rarest
    of each (size - ceil(similarity * size) + 1); those are joined per length partition, pairs whose
    lengths differ too much are pruned, and the rest is verified.
    """
    fps = fingerprints(docs, key, text, anchors).withColumn("class", F.xxhash64("signatures"))
    fps = materialize(fps, "spotsigs")
    sets = materialize(fps.groupBy("class").agg(F.first("signatures").alias("s")), "spotsig-sets")
    members = sets.where(F.size("s") > 0).select("class", F.size("s").alias("n"), F.explode("s").alias("m"))
    rarity = members.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    ranked = members.join(rarity, "m").withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy("df", "m")))
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity) + 1e-9).cast("int")
    prefix = ranked.where((F.col("df") > 1) & (F.col("k") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)).select("class", "n", "m", part.alias("part"))
    left = prefix.select(F.col("class").alias("a"), F.col("n").alias("an"), "m", "part")
    right = prefix.select(F.col("class").alias("b"), F.col("n").alias("bn"), "m", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    near = left.join(right, ["m", "part"]).where((F.col("a") != F.col("b")) & (F.col("an") <= F.col("bn")) & (F.col("an") >= F.col("bn") * similarity - 1e-9))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = (sets.select(F.col("class").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    pairs = near.join(one, "a").join(two, "b").withColumn("likeness", jaccard("sa", "sb")).where(F.col("likeness") >= similarity - 1e-12).select("a", "b", "likeness")
    pairs = materialize(pairs, "spotsig-pairs")
    groups = components(pairs)
    told = fps.join(groups, F.col("class") == F.col("node"), "left").select(key, "class", F.coalesce("component", "class").alias("component"))
    return told, pairs
