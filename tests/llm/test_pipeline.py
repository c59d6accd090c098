"""The pipeline: each stage on what the one before kept, against plain versions of what it promises."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as p
from tidewell.llm import pii, quality
from tidewell.llm.queries import quality_model

from .test_operators import brute_components, brute_leaks

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"]: r for r in docs.collect()}
    one = p.quality_stage(spark, docs, SF).cache()
    model = quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_texts(docs, model).collect()}
    assert {r["doc_id"] for r in one.collect()} == {k for k, s in scores.items() if s >= 0.3}
    two = p.near_dedup_stage(spark, one, SF).cache()
    groups = brute_components([(r["doc_id"], r["text"]) for r in one.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({c for _, c in groups.values()})
    three = p.decontamination_stage(spark, two, SF).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in two.collect()], items)}
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - leaked
    four = p.pii_stage(spark, three, SF).cache()
    for r in four.collect():
        text = whole[r["doc_id"]]["text"]
        assert r["text"] == pii.redact(text, pii.find_spans(text)) and r["n_chars"] == len(r["text"])
    library = Tokenizer.from_file(p.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    rows = p.bpe_stage(spark, four, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for k, stage in enumerate((one, two, three, four)):
        assert tuple(stage.columns) == p.COLUMNS, k


def test_awkward_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (None, "some words of a text here", None, None), (None, "some words of a text here", None, None), (4, "good words " * 3000, "en", "a"), (4, "good words " * 3000, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in p.STAGES[1:]:
        docs = stage(spark, docs, SF)
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "2", "4", "None", "None"]
    assert p.STAGES[0][1](spark, spark.createDataFrame(rows[:0], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1)), SF).count() == 0


def test_near_dedup_stage_keeps_versions(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "b"), (1, text, "en", "a"), (1, "another text under the same id", "en", "a"), (2, text + " x", "en", "a"), (3, "a third one that is like none of them", "fr", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    kept = p.near_dedup_stage(spark, docs, SF)
    assert tuple(kept.columns) == p.COLUMNS
    assert sorted((r["doc_id"], r["text"], r["source"]) for r in kept.collect()) == sorted((rows[k][0], rows[k][1], rows[k][3]) for k in (1, 2, 4))
