"""The registered corpus queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import bpe, counts, exact, langid, lm, minhash, packing, topk, toxicity, urls
from .common import crc_of_id, read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Tokenizer versions whose totals are kept.
VERSIONS = {name: public_tokenizers.path(file) for name, file in (("byte_bpe_50k", "byte_bpe_50k.json"), ("byte_bpe_multi_50k", "byte_bpe_multi_50k.tiktoken"))}


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate documents: five-word shingles, similarity 0.8 or more."""
    return minhash.near_dedup(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out third."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_of_id() % 3 != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in documents; the largest doc_id of each group stays."""
    return exact.exact_dedup(read(spark, sf_dir, "documents"), keep="max")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens, each with the corpus's mixture of sources."""
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=1, with_ids=False)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of all but the held-out seventh."""
    docs = read(spark, sf_dir, "documents")
    scored = lm.score(docs, *lm.train(docs, crc_of_id() % 7 != 2))
    return scored.withColumn("held_out", crc_of_id() % 7 == 2)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from lang outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs, crc_of_id() % 5 != 0))
    return found.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "lang_pred", "score")


#: The contract's rules (host, path, verdict).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the five rules; what no rule fits is allowed."""
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES), default="allow")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after inserts, revisions and deletes of all documents."""
    return counts.token_rollup(read(spark, sf_dir, "documents"), VERSIONS, public_tokenizers.PATTERN)


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return bpe.digests(read(spark, sf_dir, "documents"), TOKENIZER)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector against all others."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_minhash_dedup, op2_toxicity, op3_exact_dedup, op4_packing, op5_lm_scoring, op6_langid, op7_url_filters, op8_token_counts, op9_bpe_roundtrip, op10_exact_topk)}

ORACLES: dict[str, str] = {
    "op7_url_filters": r"""
        WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT page_id,
                         translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        best AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
                 FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)""",
    "op10_exact_topk": """
        WITH parts AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
                   FROM parts q JOIN parts c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op3_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               CAST(count(*) OVER (PARTITION BY coalesce(text, '')) AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
}
