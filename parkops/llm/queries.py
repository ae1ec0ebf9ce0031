"""The ``opN_*`` queries: each operator over its whole table, as its contract says."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkops.llm import (bytebpe, chat, common, imatch, jaccard, lexical, mixing, oracles, packing,
                         secretscan, simple8b, spelling, suffixdedup, topk, toxicity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bytebpe.encode(common.read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bytebpe.digests(ids, ranks, public_tokenizers.PATTERN)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.read(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.dedup(common.read(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(common.read(spark, sf_dir, "documents"),
                           public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/parkops-ids-{uuid.uuid4().hex}"
    simple8b.write(common.read(spark, sf_dir, "documents"),
                   public_tokenizers.path("word_bpe_49k.json"), path)
    return simple8b.read_digests(spark, path)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.id_text(common.read(spark, sf_dir, "documents"))
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("_score").alias("score"),
        F.col("_predicted").alias("predicted"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.read(spark, sf_dir, "conversations")
    return chat.format_chats(turns, chat.fit(turns))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(common.read(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(common.read(spark, sf_dir, "benchmark"),
                          common.read(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(common.read(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_byte_level_bpe, op3_exact_top_k, op4_suffix_dedup, op5_secret_scan,
    op6_binary_output, op7_toxicity, op8_ngram_jaccard, op9_chat_formatting,
    op10_imatch_fingerprints, op11_ranked_search, op12_source_mix, op13_spelling_variants)}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": oracles.RANKED_SEARCH, "op12_source_mix": oracles.source_mix(),
    "op13_spelling_variants": oracles.SPELLING_VARIANTS}
