"""The numbered operators over their whole tables, with production parameters.

What each gives for nulls, ties, repeated rows, empty tables and other columns is stated at the operator that it calls.
"""

from __future__ import annotations

import public_tokenizers

from buildlens.llm import bpe, byte_bpe, decontam, jaccard, langid, license, lm, quality, resample, sharding, sstable, topk, variants
from buildlens.llm.common import by_small_batches, read

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_language_id(spark, sf_dir):
    by_small_batches(spark)
    return langid.identify(read(spark, sf_dir, "documents"))


def op2_lm_score(spark, sf_dir):
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op3_token_ids(spark, sf_dir):
    return sstable.ids_of_documents(read(spark, sf_dir, "documents"), BYTE_BPE)


def op4_quality(spark, sf_dir):
    by_small_batches(spark)
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontamination(spark, sf_dir):
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_bpe(spark, sf_dir):
    return bpe.digest_documents(read(spark, sf_dir, "documents"), WORD_BPE)


def op7_top_k(spark, sf_dir):
    return topk.search_embeddings(read(spark, sf_dir, "embeddings"))


def op8_license(spark, sf_dir):
    return license.scan_licenses(read(spark, sf_dir, "documents"))


def op9_sharding(spark, sf_dir):
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    by_small_batches(spark)
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op11_byte_bpe(spark, sf_dir):
    return byte_bpe.digest_documents(read(spark, sf_dir, "documents"), BYTE_RANKS)


def op12_resample(spark, sf_dir):
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_variants(spark, sf_dir):
    return variants.group_variants(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_lm_score": op2_lm_score,
    "op3_token_ids": op3_token_ids,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_top_k": op7_top_k,
    "op8_license": op8_license,
    "op9_sharding": op9_sharding,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_resample": op12_resample,
    "op13_variants": op13_variants,
}
ORACLES: dict[str, str] = {
    "op7_top_k": topk.ORACLE,
    "op8_license": license.ORACLE,
}
