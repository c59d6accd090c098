"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, license_scan, lm, near_dedup, pii, quality, topk, url_filter


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, over shingles of four words."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=4, percent=80)


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, mod modulus; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % modulus


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.CompressionModel:
    """The classifier, learned from the labels outside the held-out fifth."""
    return quality.fit_labelled(docs, labels.where(remainder(5) != 0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.score_texts(docs, model, keep_text=False)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors for every vector whose id 50 divides."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, the digest of the base spans, all spans."""
    add = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    return pii.scan_pii(table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False, add=add)


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizers' package keeps a file; it is installed on every node."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and digests of the ids and the decoded text of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode_texts(docs, tokenizer_path(), add=("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"), keep_html=False)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's and the unigram base's log10 probability of every document."""
    return lm.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages", "page_id", "url")).drop("url")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items they hold."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontam.find_leaks(docs, items)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage by name."""
    return {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_topk, op4_pii, op5_bpe, op6_html, op7_lm, op8_url_filter, op9_decontamination, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_near_dedup": near_dedup.oracle_sql(), "op3_topk": topk.oracle_sql(), "op8_url_filter": url_filter.oracle_sql(), "op10_license_scan": license_scan.oracle_sql()}
