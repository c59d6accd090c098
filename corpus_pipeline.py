"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; run() writes each stage's result as Parquet in the shared folder and
reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, decontam, near_dedup, pii, quality
from tidewell.llm.queries import quality_model, table, tokenizer_path
from tidewell.llm.textcore import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the model learns from labels outside the held-out fifth."""
    model = quality_model(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score_texts(docs, model).where("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one of smallest id.

    Rows that share an id are versions of one document: of those with one text
    the least by its other columns stays.  Rows with a null id stay.
    """
    found = near_dedup.near_duplicates(docs, size=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    once = kept.join(repeated, "doc_id", "left_anti")
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    versions = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("rest"))
    return once.unionByName(versions.select("doc_id", "text", "rest.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    found = pii.scan_pii(docs.drop("n_chars"), add=("redacted",), keep_text=False)
    return found.withColumnRenamed("redacted", "text").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with the digests of the ids and of the decoded text."""
    wanted = docs.select("doc_id", "text", "lang", "source")
    return bpe.encode_texts(wanted, tokenizer_path(), add=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep_text=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express compression, SimHash or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
