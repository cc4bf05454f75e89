"""The operators as queries over the test tables, in the forms their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import decode_documents, encode_documents
from llm.embedding_neardup import near_duplicates
from llm.fingerprint import compare_with_next
from llm.hard_negatives import hard_negatives
from llm.ngram_join import ngram_jaccard_join
from llm.packing import packed_documents
from llm.pieces import encode_texts
from llm.pii import KINDS, pii_spans, span_text
from llm.quality import quality_resample
from llm.token_counts import token_counts
from llm.token_files import new_folder, read_token_files, write_token_files
from llm.toxicity import HELD_OUT, toxicity
from llm.vector_codes import compress


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packed_documents(documents(spark, sf_dir), tokenizer, with_sequences=False)


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: int) -> Column:
        # one parameter: of two, Spark takes the second for the place in the array
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return pii_spans(documents(spark, sf_dir)).select(
        "doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("all")).alias("spans"),
    )


def op4_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_resample(documents(spark, sf_dir), labels).select(
        "doc_id", "log_weight", "gumbel_key", "selected"
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    shards = write_token_files(documents(spark, sf_dir), tokenizer, new_folder(spark))
    return read_token_files(shards).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op6_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(documents(spark, sf_dir), labels).select(
        "doc_id",
        F.expr(f"{HELD_OUT.format('doc_id')} = 1").alias("held_out"),
        "score",
        F.expr("int(score >= 0.7)").alias("predicted"),
        "rejected",
    )


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "decodes"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    decoded = decode_documents(encode_documents(documents(spark, sf_dir), tokenizer), tokenizer)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_pii_spans": op3_pii_spans,
    "op4_quality_resample": op4_quality_resample,
    "op5_token_files": op5_token_files,
    "op6_conv_toxicity": op6_conv_toxicity,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_unigram_pieces": op8_unigram_pieces,
    "op9_token_counts": op9_token_counts,
    "op10_fingerprints": op10_fingerprints,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_bpe_transducer": op12_bpe_transducer,
    "op13_vector_codes": op13_vector_codes,
}
