"""The opN_ queries: each applies its operator, with production parameters, to its whole table.

The scratch tables that a result is read from are removed when its query runs again, or at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import concurrency, divergence, extraction, hilbert, language, packing, pii, secrets, simhash, templates, tokens, toxicity, warc
from .common import bucket, release, table


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op10")
    return secrets.secret_digest(table(spark, sf_dir, "documents"), tag="op10")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op9")
    return simhash.simhash_digest(table(spark, sf_dir, "documents"), tag="op9")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op5")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.filter(bucket(F.col("doc_id"), 3) != 1).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, learned, tag="op5")
    return toxicity.toxicity_scores(docs, model).select(
        "doc_id",
        (bucket(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op1")
    return tokens.token_digest(table(spark, sf_dir, "documents"), tag="op1")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(bucket(F.col("doc_id"), 5) != 0))
    return language.identify(docs, model).select(
        "doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op2")
    return templates.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), tag="op2")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op6")
    return packing.pack(packing.token_lengths(table(spark, sf_dir, "documents")), tag="op6")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op4")
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), tag="op4")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op7")
    return warc.warc_digest(table(spark, sf_dir, "pages"), tag="op7")


def op11_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op11")
    return concurrency.sales_concurrency(*[table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")], tag="op11")


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op12")
    return extraction.main_texts(table(spark, sf_dir, "pages"), tag="op12")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    release("op13")
    return divergence.divergence(table(spark, sf_dir, "documents"), tag="op13")


QUERIES = {
    "op4_neighbours": op4_neighbours,
    "op7_warc": op7_warc,
    "op2_decontamination": op2_decontamination,
    "op6_packing": op6_packing,
    "op1_tokens": op1_tokens,
    "op8_language": op8_language,
    "op5_toxicity": op5_toxicity,
    "op9_simhash": op9_simhash,
    "op3_pii": op3_pii,
    "op10_secrets": op10_secrets,
    "op11_concurrency": op11_concurrency,
    "op12_extraction": op12_extraction,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op11_concurrency": concurrency.SQL,
    "op13_divergence": divergence.SQL,
}
