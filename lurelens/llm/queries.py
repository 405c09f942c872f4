"""Registered queries of the operators, over their whole tables, and SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens.llm import bpe, decontamination, licenses, lm, minhash, mixing, negatives, pii, secrets, token_files, topk, toxicity, whitening
from lurelens.llm.common import shared_folder, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer(name: str) -> tuple[str, str]:
    """Place of a public vocabulary and the pattern that cuts text for it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = written(pii.with_candidates(table(spark, sf_dir, "documents")).select("doc_id", "__spans"), shared_folder(spark), "spans")
    return pii.digest(spans, pii.fit(spans))


@_query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, 5)


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_multi_50k.tiktoken"))


@_query
def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.tiktoken"), shared_folder(spark))


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ids"
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json")[0])
    return token_files.document_positions(spark, folder).withColumnRenamed("id", "doc_id")


@_query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.BlobLedger(spark, shared_folder(spark))
    return secrets.digest(secrets.scan_documents(table(spark, sf_dir, "documents"), ledger))


@_query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"), shared_folder(spark))


@_query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), shared_folder(spark), 16)


@_query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), shared_folder(spark)).drop("key")


@_query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shared_folder(spark), label=moved)


ORACLES["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

ORACLES["op10_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM w
),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
g AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, w.b FROM r JOIN both_ways w ON r.b = w.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""

#: Marks as in mixing.MARKS; u takes the first 52 bits of a digest of seed and id.
ORACLES["op12_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS missing, coalesce(source, '') AS name, coalesce(text, '') AS text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
),
w AS (
  SELECT doc_id, missing, name, size,
    greatest(0.05::DOUBLE, length(translate(text, '0123456789!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''))::DOUBLE / greatest(length(text), 1) * (size::DOUBLE / (size + 20.0::DOUBLE))) AS weight,
    (CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), md5(text))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d
),
k AS (SELECT *, -ln(u) / weight AS key FROM w),
s AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / part AS fills_at FROM (
    SELECT missing, name, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY missing, name) - 1) % 3] AS part FROM k GROUP BY 1, 2
  )
),
l AS (
  SELECT *, (sum(source_size) OVER () * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fills_at, missing, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(part) OVER (ORDER BY fills_at, missing, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
),
t AS (
  SELECT missing, name, source_size, CASE WHEN level < fills_at THEN max(CASE WHEN level < fills_at THEN level END) OVER () * part ELSE CAST(cap AS DOUBLE) END AS target FROM l
),
r AS (
  SELECT k.doc_id, k.size, k.weight, k.key, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.missing, k.name ORDER BY k.key, k.doc_id) - k.size AS earlier
  FROM k JOIN t USING (missing, name)
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - earlier)) AS BIGINT) AS taken, epochs, weight FROM r
"""

ORACLES["op13_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum(list_transform(generate_series(1, len(q.w)), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS positive_rank FROM s WHERE same
),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, p.positive_rank,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.positive_rank <= 5 AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(positive_rank AS INTEGER) AS positive_rank FROM n WHERE rank <= 5
"""
