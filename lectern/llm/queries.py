"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .asof import HOUR, asof_join, clicks_to_match, orders_of_sales
from .bpe import round_trips
from .common import scratch, stored, table
from .exact_dedup import exact_dedup
from .negatives import hard_negatives, labelled
from .packing import pack_documents
from .quality import quality_scores
from .secrets import scan_secrets
from .sharding import write_shards
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .topk import block_topk, quantised
from .toxicity import toxicity_scores
from .warc import archived_pages, read_warc, write_warc


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_layers", "complete")


def op3_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return block_topk(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_shards(table(spark, sf_dir, "documents"), shards=8)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return written.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))[0]


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("same")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = labelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return archived_pages(read_warc(spark, path)).drop("complete")


def op13_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = stored(clicks_to_match(table(spark, sf_dir, "clicks")), "clicks")
    return asof_join(clicks, orders_of_sales(table(spark, sf_dir, "sales")), 720 * HOUR)


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_secret_scans, op3_exact_topk_search, op4_toxicity, op5_packing, op6_sharding, op7_substring_dedup, op8_bpe_round_trip, op9_quality_classifier, op10_exact_dedup, op11_hard_negatives, op12_warc, op13_asof_join)}

#: crc32 of a whole number's digits, from its definition: SQL has no such function.
_CRC = "xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 1, 2, 3, 4, 5, 6, 7]), lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))))"
_SIX_HOURS = 6 * HOUR
_COARSE = "CASE WHEN h % 2 = 1 THEN us - (us % {0} + {0}) % {0} ELSE us END".format(_SIX_HOURS)

ORACLE_SQL = {
    "op3_exact_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT w.doc_id, w.i, unnest(range(0, 13)) AS j FROM w JOIN m USING (k) WHERE w.doc_id > m.least)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.pos) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
""",
    "op12_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS top FROM p),
b AS (SELECT *, list_transform(string_split(h, ''), lambda c: strpos('0123456789abcdef', c) - 1) AS x FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: ((x[1 + (5 * i + j) // 4] >> (3 - (5 * i + j) % 4)) & 1) << (4 - j))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
""",
    "op13_asof_join": f"""
WITH c AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, {_CRC.format("click_id")} AS h FROM clicks WHERE click_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts DESC NULLS LAST, client_id DESC NULLS LAST) = 1
), k AS (SELECT click_id, client_id, {_COARSE} AS ts_us FROM c),
s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS us, CASE WHEN isfinite(total) THEN CAST(floor(100 * total + 0.5) AS BIGINT) END AS total_cents, CASE WHEN sale_id IS NULL THEN 0 ELSE {_CRC.format("sale_id")} END AS h FROM sales),
t AS (SELECT sale_id, client_id, {_COARSE} AS order_us, total_cents, h FROM s),
o AS (SELECT sale_id, client_id, order_us, total_cents FROM t UNION ALL SELECT -1 - sale_id, client_id, order_us, total_cents FROM t WHERE h % 3 <> 0),
g AS (
  SELECT client_id, order_us, sale_id, total_cents, count(*) OVER (PARTITION BY client_id, order_us) AS n_tied FROM o WHERE client_id IS NOT NULL AND order_us IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY client_id, order_us ORDER BY total_cents DESC NULLS LAST, sale_id DESC NULLS LAST) = 1
), m AS (
  SELECT k.click_id, g.* EXCLUDE (client_id) FROM k JOIN g ON k.client_id = g.client_id AND g.order_us <= k.ts_us AND g.order_us >= k.ts_us - {720 * HOUR}
  QUALIFY row_number() OVER (PARTITION BY k.click_id ORDER BY g.order_us DESC) = 1
)
SELECT k.click_id, k.client_id, k.ts_us, m.sale_id, k.ts_us - m.order_us AS lag_us, m.total_cents, coalesce(m.n_tied, 0) AS n_tied FROM k LEFT JOIN m USING (click_id)
""",
}
