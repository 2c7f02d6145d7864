"""The registered queries of the operators, and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import bpe, chat, decontam, hardneg, maxent, neardup, phrases, pii, quality, repeats, sharding, tokenfile, urltrie
from orderlens.llm.oracles import ORACLES as ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_documents(spark, sf_dir))
    return out.select("doc.doc_id", *(f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_chars", "kept")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(extra)
    out = chat.read_back(chat.format_trees(chat.conversation_messages(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
                      F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
                      F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(_documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return out.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_benchmark(_documents(spark, sf_dir), _read(spark, sf_dir, "benchmark"))
    return out.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_maxent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(_documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, dictionary = tokenfile.write_images(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return tokenfile.read_images(images, dictionary)


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, changed = repeats.repeated_substrings(_documents(spark, sf_dir))
    out = base.join(changed.select("k", "h", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha")), ["k", "h"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
                      F.coalesce("kept_sha", "sha").alias("kept_sha256"), (F.coalesce("n_removed", zero) > 0).alias("repeated"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(_documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc.doc_id", *map(count, pii.KINDS), F.sha2(pii.spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                      pii.spans_text(F.col("spans")).alias("spans"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    out = hardneg.mine_hard_negatives(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: the contract's rules: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = urltrie.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page.page_id", "host", "path", "rule", "verdict")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_chat_format, op3_minimax_shards, op4_byte_bpe, op5_decontaminate,
    op6_maxent_score, op7_token_files, op8_repeated_substrings, op9_personal_data, op10_near_duplicates,
    op11_hard_negatives, op12_url_filter, op13_collocations)}
