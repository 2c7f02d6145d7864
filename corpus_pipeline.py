"""Corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and rereads it as the next stage's documents. All stages but
the last return the columns of their input. A stage keeps every row that it has no reason
to drop: rows with a null doc_id stay, and so do different texts under one doc_id (of rows
that repeat both, and of copies without an id, the near-duplicate stage keeps one); an empty
table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import bpe, decontam, neardup, pii, quality
from orderlens.llm.shared import store, text_or_empty


def _with_text(rows: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The input's columns again, with a new text and its length."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go."""
    out = quality.quality_rules(docs).where("quality.kept")
    return _with_text(out, docs, F.col("quality.clean_text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, documents without an id included: the
    one with the smallest id, and one row of it. A text without words is no copy of anything."""
    found = neardup.groups(docs, null_ids=True)
    leads = F.col("leader").isNull() | (F.col("leader.id").eqNullSafe(F.col("id")) & (F.col("leader.h") == F.col("h")))
    kept = found.where(leads).select(F.col("id").alias("__id"), F.col("h").alias("__h"), (F.col("n") == 0).alias("__bare")).distinct()
    known = docs.withColumn("__text", F.xxhash64(text_or_empty())).join(
        kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__h")))
    rows = known.where("not __bare").dropDuplicates(["doc_id", "__text"]).unionByName(known.where("__bare"))
    return rows.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.find_benchmark(docs, benchmark).where("n_hit = 0").select("doc.*")


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    out = pii.find_personal_data(docs)
    text = F.col("doc.text")
    return _with_text(out, docs, F.when(F.size("spans") > 0, pii.mask(text, F.col("spans"))).otherwise(text))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the bytes decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return out.select("doc.doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", personal_data_stage),
    ("byte-level bpe", token_stage),
]

#: the model of the personal-data stage and the token ids have no SQL twin
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
