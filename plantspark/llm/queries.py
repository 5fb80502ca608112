"""Registered queries of the text operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, hard_negatives, html_text, mixing, pii, prefix_trie, quality, secret_scan, sharding, simhash, substring_dedup, token_counts
from .common import cut, prepare, table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Words between blanks, and the words of the contamination rule (A-Z in lower case first).
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op4_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS id, {_PLAIN} AS ws FROM benchmark),
pat AS (SELECT DISTINCT id, least(13, len(ws)) AS l, array_to_string(ws[i:i + 12], ' ') AS k FROM b, unnest(range(1, greatest(2, len(ws) - 11))) AS t(i) WHERE len(ws) > 0),
win AS (SELECT r, i, l, array_to_string(ws[i:i + l - 1], ' ') AS k FROM d, (SELECT DISTINCT l FROM pat), unnest(range(1, len(ws) - l + 2)) AS t(i)),
hit AS (SELECT r, i, l, id FROM win JOIN pat USING (l, k)),
cov AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""

ORACLES["op9_repeated_passages"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(ws) - 33)) AS t(i)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN rep USING (k)),
gone AS (SELECT r, count(*) AS n FROM cov GROUP BY r),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d) ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""


# The rebuilt conversations; CRC-32 bit by bit, over the decimal id.
ORACLES["op11_prefix_trie"] = r"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) - 1 AS pos, dg, tok FROM (
  SELECT conv_id, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tok FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM ids UNION ALL
  SELECT conv_id, s, i + 1, xor(b // 2, CASE WHEN b % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) FROM (
    SELECT conv_id, s, i, xor(c, CASE WHEN i % 8 = 0 THEN CAST(ascii(s[i // 8 + 1]) AS BIGINT) ELSE 0 END) AS b FROM crc WHERE i < 8 * length(s))),
h AS (SELECT conv_id, (4294967295 - c) % 4 AS h FROM crc WHERE i = 8 * length(s)),
k AS (SELECT ids.conv_id, ids.n, ids.base, h.h, least(h.h, coalesce(b.n, 0)) AS f FROM ids JOIN h USING (conv_id) LEFT JOIN ids b ON b.conv_id = ids.base),
r AS (SELECT k.conv_id, t.pos + 1 AS d, t.dg, t.tok FROM k JOIN t ON t.conv_id = k.base AND t.pos < k.f
  UNION ALL SELECT k.conv_id, t.pos - k.h + k.f + 1, t.dg, t.tok FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos >= k.h),
m AS (SELECT conv_id, d, string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path, tok FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM k),
z AS (SELECT conv_id, max(d) AS last FROM m GROUP BY conv_id),
x AS (SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, max(tok) AS tok, string_agg(CASE WHEN d = last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM m JOIN z USING (conv_id) GROUP BY d, path),
y AS (SELECT x.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children FROM x
  LEFT JOIN x p ON x.d > 0 AND p.d = x.d - 1 AND p.path = left(x.path, 64 * (x.d - 1))
  LEFT JOIN (SELECT d - 1 AS d, left(path, 64 * (d - 1)) AS path, count(*) AS n_children FROM x WHERE d > 0 GROUP BY ALL) c ON c.d = x.d AND c.path = x.path),
a AS (SELECT m.d, m.path, CAST(count(CASE WHEN y.n_children = 0 THEN 1 END) AS BIGINT) AS n_leaves, CAST(sum((y.n - 1) * y.tok) AS BIGINT) AS saved_tokens
  FROM y JOIN m ON m.conv_id = y.conv_id AND m.d <= y.d GROUP BY m.d, m.path)
SELECT y.conv_id, CAST(y.d AS BIGINT) AS depth, y.parent_conv_id, CAST(y.n AS BIGINT) AS n_convs, CAST(y.n_children AS BIGINT) AS n_children,
  a.n_leaves, a.saved_tokens, sha256(coalesce(y.ends, '')) AS ends_sha256 FROM y JOIN a USING (d, path)"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 10"""


def query(plan: Callable[[SparkSession, str], DataFrame]):
    @wraps(plan)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return plan(spark, sf_dir)

    QUERIES[plan.__name__] = run
    return plan


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def op1_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    narrow = _documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.place(cut(narrow), "doc_id", 16, ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extracted(pages).select("page_id", "url", "text", "n_chars")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = ("n_tokens", "ids_sha256", "decoded_sha256")
    return byte_bpe.encoded(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, outputs=out).select("doc_id", *out)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_documents(spark, sf_dir)).select("doc_id", "pii")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(pii.number(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("pii")).alias("spans"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_documents(spark, sf_dir))
    counts = (secret_scan.number(F.col("base"), k).alias(f"n_{k}") for k in secret_scan.KINDS[:3])
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality.measure(_documents(spark, sf_dir)).drop("text"))
    judged = quality.judge(measured, quality.fit(measured))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = cut(simhash.fingerprints(_documents(spark, sf_dir)).drop("text"))
    found = simhash.clustered(prints)
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(_documents(spark, sf_dir))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.counted(_documents(spark, sf_dir), model).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.branched(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(rebuilt).drop("path", "parent")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.prepared(table(spark, sf_dir, "embeddings"), relabel=moved)
    return hard_negatives.mine(rows, rows.where("id % 100 = 0"))


@query
def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
