"""The registered queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, chat, embedding_dedup, fim, licenses, lm, mixing, pieces, quality, simhash, substrings, token_files
from .common import is_fold, materialise, shared_folder

#: Paths of vocabularies are parameters of the operators; these are the queries' choices.
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/logloom-tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, BPE, end_id=2)
    return token_files.with_crc(token_files.read_token_files(spark, path))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    best = F.aggregate("found", F.lit(0.0), lambda m, f: F.greatest(m, f.coverage))
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"), best.alias("best_coverage"), F.col("found.start").alias("starts"), F.col("found.end").alias("ends"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = is_fold(F.col("doc_id"), 0)
    model = quality.fit(docs.where(~held_out), _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), ~is_fold(F.col("doc_id"), 1))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, PIECES).drop("text")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    return chat.read_back(materialise(chat.format_chats(rows.unionByName(more), BPE), "chats")).drop("n_ids", "n_loss_ids")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(_table(spark, sf_dir, "documents"), seed=1)
    again = fim.restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = audit.document_masks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return audit.audit(masks, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_token_files, op3_license_scan, op4_quality_classifier, op5_embedding_near_dedup, op6_lm_scores, op7_sentencepiece, op8_nearest_neighbours, op9_source_mix, op10_chat_format, op11_substring_dedup, op12_fill_in_middle, op13_filter_audit)}
