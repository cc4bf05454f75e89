"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Target text is that of rows labelled of good quality (a bounded sample, least hash of the
doc_id first), raw text that of all rows. Each is a bag of hashed unigrams and bigrams of words
and runs of signs, case kept; all rows' counts are added up in one pass. A row's log weight is
the mean log ratio of the two models over its n-grams, times ``SCALE`` n-grams, so that long and
short texts compare. Keys are log weights plus ``TEMPERATURE`` times Gumbel noise, a fixed
function of doc_id and seed; the k greatest keys are the resample. Unless given, k is the number
of rows that the labels make one expect to be good: the share of good ones among labelled rows
at each log weight, summed over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from llm.shared import cut, ship
from llm.words import EXACT, PUNCT, mix, words_by_text

FIT_ROWS = 5000
BUCKETS = 1 << 14
SMOOTH = 1.0
SCALE = 20.0
TEMPERATURE = 0.1
STEP = 1 << 12  # bins of a pass that looks for the k-th key


def ngram_buckets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the bucket of every unigram and bigram."""
    for words in words_by_text(column, PUNCT, EXACT):
        pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
        yield (np.concatenate((words, pairs)) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Counts of the n-gram buckets in all texts (row 0) and in those of ``target`` ids (row 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            marks = b.column(1).to_pylist()
            for mark, buckets in zip(marks, ngram_buckets(b.column(0)), strict=True):
                part = np.bincount(buckets, minlength=BUCKETS) if len(buckets) > BUCKETS // 16 else None
                for k in (0, 1) if mark else (0,):
                    if part is None:
                        np.add.at(counts[k], buckets, 1)
                    else:
                        counts[k] += part
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(counts[0]), pa.array(counts[1])], ["bucket", "raw", "target"]
        )

    marked = docs.select("doc_id", "text").join(F.broadcast(target.withColumn("mark", F.lit(True))), "doc_id", "left")
    rows = marked.select("text", "mark").mapInArrow(run, "bucket long, raw long, target long")
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows
        counts[:, r[0]] = r[1], r[2]
    return counts


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, 0 everywhere if there is no target text."""
    if counts[1].sum() == 0:
        return np.zeros(BUCKETS)
    p = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def good_share(labelled: list[tuple[float, int]], bins: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Cuts between log weights, and the share of good rows between them, never falling."""
    if not labelled:
        return np.zeros(0), np.ones(1)
    w, y = map(np.array, zip(*sorted(labelled), strict=True))
    cuts = np.unique(np.quantile(w, np.linspace(0, 1, bins + 1)[1:-1]))
    place = np.searchsorted(cuts, w, "right")
    good = np.bincount(place, weights=y, minlength=len(cuts) + 1)
    n = np.bincount(place, minlength=len(cuts) + 1)
    blocks: list[list[float]] = []  # pooled until shares ascend
    for g, m in zip(good, n, strict=True):
        blocks.append([g, m, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, m2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + m2, blocks[-1][2] + k2]
    share = np.concatenate([np.full(int(k), g / m if m else 0.0) for g, m, k in blocks])
    return cuts, share


def kth_greatest(keys: DataFrame, column: str, k: int) -> float:
    """The k-th greatest value, exactly, by passes that count values in ever narrower bins."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).head()
    if n == 0 or k <= 0:
        return float("inf")
    if k >= n:
        return float(low)
    within, wanted = keys.where(F.col(column).isNotNull()), k
    while low < high:
        width = (high - low) / STEP
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(STEP - 1)) if width > 0 else F.lit(0)
        found = within.groupBy(place.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        ).collect()  # at most STEP rows
        for r in sorted(found, key=lambda r: -r["bin"]):
            if wanted <= r["n"]:
                low, high = r["low"], r["high"]
                break
            wanted -= r["n"]
        within = within.where(F.col(column).between(low, high))
    return float(low)


def quality_resample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """``docs`` with ``log_weight``, ``gumbel_key`` and ``selected`` (key among the k greatest).

    Texts without n-grams, null ones too, have log weight 0. Rows tied with the k-th are all
    selected. Labels other than 0 and 1 are left out; without labels all rows are selected unless
    k is given. Rows that repeat a doc_id share their noise; a null doc_id has a fixed one.
    """
    spark = docs.sparkSession
    ship(spark)
    clean = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # fitted on one part of the labelled rows, k learnt from another
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    target = clean.where((F.col("quality") == 1) & (part == 0)).orderBy(*order).limit(fit_rows).select("doc_id")
    held = clean.where(part == 1).orderBy(*order).limit(fit_rows)
    shared = spark.sparkContext.broadcast(log_ratio(bucket_counts(docs, target)))  # BUCKETS numbers
    names = [c for c in docs.columns if c not in ("log_weight", "gumbel_key", "selected")]
    at = names.index("text")
    plain = docs.select(*[F.col(f"`{c}`") for c in names])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for b in batches:
            w = [SCALE * float(ratio[g].mean()) if len(g) else 0.0 for g in ngram_buckets(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w, pa.float64())], [*names, "log_weight"])

    def keyed(df: DataFrame) -> DataFrame:
        u = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return df.withColumn("gumbel_key", F.col("log_weight") - TEMPERATURE * F.log(-F.log(u)))

    weighed = plain.mapInArrow(weigh, StructType([*plain.schema, StructField("log_weight", DoubleType())]))
    keys = cut(keyed(weighed.select("doc_id", "log_weight")))
    if k is None:
        seen = keys.join(F.broadcast(held), "doc_id").select("log_weight", "quality").collect()  # fit_rows, bar copies of an id
        cuts, share = good_share([(r[0], r[1]) for r in seen])
        place = F.lit(float(share[0]))
        for c, s in zip(cuts, share[1:], strict=True):
            place = F.when(F.col("log_weight") >= float(c), F.lit(float(s))).otherwise(place)
        k = round(keys.agg(F.sum(place)).head()[0] or 0)
    least = kth_greatest(keys, "gumbel_key", k)
    return keyed(weighed).withColumn("selected", F.col("gumbel_key") >= F.lit(least))
