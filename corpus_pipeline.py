"""The corpus pipeline over ``documents``: five stages, each written and read again.

1. toxicity: documents predicted toxic go (labels of the same tables teach the model);
2. n-gram Jaccard join: of each group of near duplicates the smallest doc_id stays;
3. suffix-array dedup: passages that an earlier document has are cut out of the text;
4. secret scans: secrets are masked in the text;
5. best-fit packing: what is left as pieces of fixed-length sequences.

All but the last return the columns of ``documents`` with their types; stages that change
a text also update ``n_chars``. A document whose whole text was a copy keeps its row, empty.
doc_ids may be null or repeat: rows are told apart by doc_id and text. Of a group of near
duplicates one row stays, that of the smallest doc_id (null last), of equal ones the row
whose other columns have the least hash; empty texts are near nothing. The last stage gives
pieces with their token ids.

A stage's own tables in the shared folder are deleted when the next stage starts, as its
result has been written by then; those that documents not written still read stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parkops.llm import common, jaccard, packing, secretscan, suffixdedup, toxicity


_LEFT: list[str] = []


def stage(fn: Callable) -> Callable:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(spark, _LEFT, docs)
        with common.noting(_LEFT):
            return fn(spark, docs, sf_dir)
    return run_stage


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    names = tuple(common.free_name(n, docs.columns) for n in ("_score", "_predicted"))
    return toxicity.score(docs, model, names).filter(F.col(names[1]) == 0).select(*docs.columns)


@stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component. Rows equal in doc_id and text share a key; keys with
    several rows are few beside the rest, so only their rows are grouped."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(),
                     F.coalesce("text", F.lit("")))
    name = common.free_name("_key", docs.columns)
    keyed = docs.withColumn(name, key)
    found = common.written(jaccard.join(keyed.select(F.col(name).alias("doc_id"), "text"))
                           .select(F.col("doc_id").alias("_k"), "component_id", "n_shingles")
                           .groupBy("_k").agg(F.first("component_id").alias("_c"),
                                              F.max("n_shingles").alias("_n"),
                                              F.count(F.lit(1)).alias("_rows")), "components")
    ids = keyed.select(F.col(name).alias("_k"), F.struct(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
        F.col(name).alias("k")).alias("_order")).join(found.filter("_n > 0"), "_k")
    best = ids.groupBy("_c").agg(F.min("_order").alias("_o")).select(F.col("_o.k").alias("_k"))
    # marks: keys that go, and keys that stay with one of several rows; the rest need no row
    flag = common.free_name("_goes", docs.columns)
    goes = F.col("_best").isNull()
    marks = common.written(found.filter("_n > 0").join(best.withColumn("_best", F.lit(True)), "_k", "left")
                           .filter(goes | (F.col("_rows") > 1))
                           .select(F.col("_k").alias(name), goes.alias(flag)), "marks")
    rest = keyed.join(marks.select(name), name, "left_anti").select(*docs.columns)
    several = marks.filter(~F.col(flag)).select(name)
    if several.isEmpty():
        return rest
    one = (keyed.join(several, name).groupBy(name)
           .agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(flag))
           .select(F.col(flag + ".*")))
    return rest.unionAll(one)


@stage
def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = {f"_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = suffixdedup.dedup(
        docs.select("doc_id", "text", *(F.col(c).alias(n) for n, c in rest.items())),
        list(rest), as_text=True)
    out = out.select("doc_id", F.col("kept").alias("text"),
                     *(F.col(n).alias(c) for n, c in rest.items()))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@stage
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                             public_tokenizers.PATTERN)


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard", jaccard_stage),
          ("suffix_dedup", suffix_stage), ("secret_scan", secrets_stage),
          ("packing", packing_stage)]

#: Learned scores and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.read(spark, sf_dir, "documents"), []
    for name, fn in STAGES:
        made: list[str] = []
        out = fn(spark, docs, sf_dir)
        with common.noting(made):
            docs = common.written(out, f"stage-{name}")
        common.drop(spark, before)  # the stage's input, now that its result is written
        before = made
    common.drop(spark, _LEFT)
    return docs
