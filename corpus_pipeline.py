"""Documents to training sequences: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.ngram_join import ngram_jaccard_join
from llm.packing import packed_documents
from llm.pii import pii_spans, redacted
from llm.quality import quality_resample
from llm.shared import stored
from llm.toxicity import toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
REST = "other_columns"


def set_aside(docs: DataFrame) -> DataFrame:
    """The columns that stages read, and all others in one, so that no stage writes over them.

    A table without ``lang`` gets a null one.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", lang.alias("lang"), F.struct(*others, F.lit(0).alias("_")).alias(REST))


def restored(docs: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns ``names`` of a table that :func:`set_aside` made, ``changed`` ones new."""
    held = {c: F.col(c) if c in ("doc_id", "text") else F.col(f"{REST}.`{c}`") for c in names}
    return docs.select(*[changed.get(c, held[c]).alias(c) for c in names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below their language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return restored(toxicity(set_aside(docs), labels).where("NOT rejected"), docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The Gumbel top-k of documents by importance weight for good text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return restored(quality_resample(set_aside(docs), labels).where("selected"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram join: that of the least doc_id, of rows that share it any one.

    Rows are told apart by a number of their own, so a doc_id that repeats loses no text that has no
    copy, and copies without a doc_id go like others; a row with one is kept rather than one without.
    """
    rows = stored(set_aside(docs).withColumn("row", F.monotonically_increasing_id()))
    found = ngram_jaccard_join(rows.select("row", "text"), doc_id="row")
    places = rows.select("row", F.col("doc_id").alias("own")).join(found.withColumnRenamed("doc_id", "row"), "row")
    first = F.min(F.struct(F.col("own").isNull().alias("without"), "own", "row"))
    kept = places.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return restored(rows.join(kept, "row", "left_semi"), docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, ``n_chars`` counted anew where there is such a column."""
    clean = redacted(F.coalesce("text", F.lit("")), F.col("all"))
    found = pii_spans(set_aside(docs)).withColumn("text", clean)
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return restored(found, docs.columns, **changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in padded sequences of 2048 tokens, whose ids the row at offset 0 has."""
    # a smaller memo than alone: the workers of earlier stages still hold memory
    return packed_documents(docs, TOKENIZER, memo_size=100_000, group_bytes=1 << 20)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("ngram_join", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack),
]

# trained classifiers and a tokenizer decide: not for SQL, tested against plain versions of each stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to a new folder of the cluster's shared one and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
