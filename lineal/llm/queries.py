"""The registered queries of this folder's operators: opN_<name>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, line_dedup, merkle, mixing, packing, pieces, simhash, spotsigs, suffix_dedup, topk, toxicity, url_filter, warc
from .common import ascii_lower

#: A public BPE vocabulary; another file can be given by parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The vocabulary that sequences are packed with.
VOCABULARY = "word_bpe_49k.json"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.repeated_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filter(spark, sf_dir):
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op3_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op4_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "is_toxic")


def op6_mixing(spark, sf_dir):
    out = mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_spotsigs(spark, sf_dir):
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def spotsigs_groups(spark, sf_dir):
    """All documents by the search that op7's contract does not reach: sets partitioned by length, pruned Jaccard."""
    members, _ = spotsigs.similar_groups(table(spark, sf_dir, "documents"))
    return members.select("doc_id", "class", "component")


def op8_pieces(spark, sf_dir, model: str = MODEL):
    out = pieces.encode(table(spark, sf_dir, "documents"), model, 2)
    return out.select("doc_id", "sample", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("pieces_hash"), "log_prob", "perturbed", "inclusion", "log_inclusion")


def op9_warc(spark, sf_dir):
    out = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    own = F.col("payload").isNotNull()
    digest = F.when(own, F.sha2("payload", 256)).otherwise(F.col("digest"))
    size = F.when(own, F.length("payload")).otherwise(F.col("length")).cast("long")
    return out.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op10_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op11_packing(spark, sf_dir, tokenizer: str | None = None):
    import public_tokenizers

    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    row = lambda text: merkle.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", row(F.col("text")).alias("leaf"), F.when(tampered, row(ascii_lower("text"))).alias("claim"))
    return merkle.climbed(*merkle.manifest(leaves))


def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_line_dedup, op4_simhash, op5_toxicity, op6_mixing, op7_spotsigs, op8_pieces, op9_warc, op10_topk, op11_packing, op12_merkle, op13_hard_negatives, spotsigs_groups)}

_OP2 = r"""
WITH u AS (SELECT page_id, coalesce(instr(url, '://'), 0) AS found, coalesce(substr(url, instr(url, '://') + 3), '') AS rest FROM pages),
s AS (SELECT page_id, CASE WHEN found > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN found > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(verdict, rule, h, p) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
m AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
      FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
_OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
_OP10 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
_FRAMED = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Levels are told apart by number; "^" is the tree over the sources'.
_OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {_LEAF.format('text')} AS leaf, {_LEAF.format(_LOWERED)} AS lowered,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(a, x)), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv AS (SELECT tree, 0 AS lvl, place AS number, leaf AS hash, n FROM p UNION ALL SELECT tree, lvl + 1, number // 16, sha256(string_agg(hash, '' ORDER BY number)), (n + 15) // 16 FROM lv WHERE n > 1 GROUP BY tree, lvl, number // 16, n),
sr AS (SELECT tree AS of, hash, lvl FROM lv WHERE n = 1), s0 AS (SELECT of, hash, row_number() OVER (ORDER BY encode(of)) - 1 AS number, count(*) OVER () AS n FROM sr),
tv AS (SELECT '^' AS tree, 0 AS lvl, number, hash, n FROM s0 UNION ALL SELECT tree, lvl + 1, number // 16, sha256(string_agg(hash, '' ORDER BY number)), (n + 15) // 16 FROM tv WHERE n > 1 GROUP BY tree, lvl, number // 16, n),
runs AS (SELECT tree, lvl, number // 16 AS run, list(hash ORDER BY number) AS hs, max(n) AS n FROM (SELECT * FROM lv UNION ALL SELECT * FROM tv) WHERE n > 1 GROUP BY ALL),
up AS (SELECT doc_id, leaf, tree AS source, tree, 0 AS lvl, place AS number, n, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS fold, '' AS above FROM p
  UNION ALL (SELECT doc_id, leaf, source, up.tree, up.lvl + 1, up.number // 16, (up.n + 15) // 16, sha256(array_to_string(list_transform(hs, lambda h, i: CASE WHEN i = up.number % 16 + 1 THEN fold ELSE h END), '')), above || array_to_string(list_filter(hs, lambda h, i: i <> up.number % 16 + 1), '')
    FROM up JOIN runs r ON r.tree = up.tree AND r.lvl = up.lvl AND r.run = up.number // 16 WHERE up.n > 1
  UNION ALL SELECT doc_id, leaf, source, '^', 0, s0.number, s0.n, fold, above FROM up JOIN s0 ON s0.of = up.tree WHERE up.n = 1 AND up.tree <> '^')),
rt AS (SELECT hash AS root FROM tv WHERE n = 1)
SELECT doc_id, leaf, s0.hash AS subroot, root, sha256(above) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM up JOIN s0 ON s0.of = up.source, rt WHERE up.tree = '^' AND up.n = 1
"""
_OP13 = """
WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE alike),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
ORACLES = {"op2_url_filter": _OP2, "op9_warc": _OP9, "op10_topk": _OP10, "op12_merkle": _OP12, "op13_hard_negatives": _OP13}
