"""One query for each of the thirteen operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import alignment, bpe, collocations, embedding_dedup, exact_topk, licenses, packing, quality_classifier, quality_rules, simhash, token_counts, toxicity, warc
from marginalia.llm.common import stored, table

WORDS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    docs = docs.withColumn("n_chars_", F.coalesce(F.length("text"), F.lit(0)))
    out = token_counts.token_counts(docs, public_tokenizers.path(BYTES), keep=("doc_id", "n_bytes", "n_chars_"), budgets=(1024,))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("cut_1024") < F.col("n_chars_")).alias("over_limit"), "cut_1024")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = stored(quality_classifier.keyed(docs, quality_classifier.train(docs, labels)).select("doc_id", "_log_weight", "_key"), "keys")
    kept = quality_classifier.chosen(rows, quality_classifier.keep_share(labels))
    return rows.select("doc_id", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("gumbel_key"), kept.alias("kept"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"groups_sha256": ("string", alignment.groups_sha256)}
    out = alignment.with_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES), more=digest)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_bpe, op3_simhash, op4_toxicity, op5_quality_rules, op6_licenses, op7_token_counts, op8_embedding_dedup, op9_quality_classifier, op10_warc, op11_exact_topk, op12_alignment, op13_collocations)}
ORACLES = {"op5_quality_rules": quality_rules.ORACLE, "op10_warc": warc.ORACLE, "op11_exact_topk": exact_topk.ORACLE, "op13_collocations": collocations.ORACLE}
