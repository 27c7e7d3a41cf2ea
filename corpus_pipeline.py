"""From raw documents to token ids: language, quality, near duplicates, benchmark passages, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm import bpe, decontam, jaccard, langid, quality
from buildlens.llm.common import by_small_batches, doc_key, materialize, read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach, by evidence of the language itself and not against the others."""
    by_small_batches(spark)
    model = langid.train(docs.select("text", "lang", F.col("doc_id").alias("salt")))
    found = langid.predict(docs, model, prefix="_llm_", judge=True)
    return found.filter(F.col("_llm_lang_pred") != "und").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the co-trained views take for good."""
    by_small_batches(spark)
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, prefix="_llm_").filter("_llm_keep").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: that of smallest doc_id, null last, and of these one by id and text.

    Rows go by a key of id and text, so a doc_id on rows of different texts counts once for each text.
    """
    by_small_batches(spark)
    others, repeated = jaccard.redundant_keys(docs)
    kept = docs.withColumn("_llm_key", doc_key()).join(others.withColumnRenamed("key", "_llm_key"), "_llm_key", "left_anti")
    if repeated.limit(1).count():
        repeated = repeated.withColumnRenamed("key", "_llm_key")
        one_each = kept.join(repeated, "_llm_key", "left_semi").dropDuplicates(["_llm_key"])
        kept = kept.join(repeated, "_llm_key", "left_anti").unionByName(one_each)
    return kept.select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no window of a benchmark item occurs."""
    runs = decontam.contaminated_stretches(docs, read(spark, sf_dir, "benchmark"))
    hit = materialize(runs.select(F.col("key").alias("_llm_key")), "contaminated")
    return docs.withColumn("_llm_key", doc_key()).join(hit, "_llm_key", "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left; a null text is empty, rows that repeat give a row each."""
    return bpe.digest_documents(docs, WORD_BPE)


STAGES = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("jaccard_join", one_of_each),
    ("decontamination", without_benchmarks),
    ("bpe", encoded),
]

#: No SQL for fitted models; the stages are tested one by one, and the whole against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each on what the one before kept. No documents, or none left: no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
