"""Triangular factors of a model matrix, reduced by a tree of QR factorisations.

A task turns its batches into one triangular factor, factors are stacked and factorised again in
rounds of a bounded fan-in, and the driver gets the last few. Cross-products are never formed, so
an ill-conditioned matrix costs half as many digits as it would there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwave.functions.nullsafe import quoted

FAN_IN = 64
PARTIAL = "part bigint, n bigint, factor array<double>"


def stacked(blocks: Sequence[np.ndarray], p: int) -> np.ndarray:
    """The p x p triangular factor of blocks on top of each other, rows of zeros below if there are few."""
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    if len(r) < p:
        r = np.concatenate([r, np.zeros((p - len(r), p))])
    return r


def merge_rounds(df: DataFrame) -> int:
    """One round leaves the driver a factor per ``FAN_IN`` tasks, two leave one per its square."""
    spark = df.sparkSession
    widest = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return 1 if widest <= FAN_IN else 2


def triangular_factor(df: DataFrame, cols: Sequence[str], rounds: int | None = None) -> tuple[np.ndarray, int]:
    """The factor R of a column of ones and ``cols``, and the number of rows. Rows with nulls have to be gone.

    A merging task holds at most ``FAN_IN`` factors, whatever the number of tasks.
    """
    p = len(cols) + 1
    picked = df.selectExpr(*[f"CAST({quoted(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(cols)])

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor, n = np.zeros((0, p)), 0
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            factor = stacked([factor, np.column_stack([np.ones(len(values)), values])], p)
            n += len(values)
        if n:
            yield pd.DataFrame([{"part": TaskContext.get().partitionId(), "n": n, "factor": factor.ravel()}])

    def merge(block: pd.DataFrame) -> pd.DataFrame:
        if len(block) > FAN_IN:
            raise ValueError(f"{len(block)} factors met in one task")
        r = stacked([np.reshape(f, (p, p)) for f in block["factor"]], p)
        return pd.DataFrame([{"part": block["part"].iloc[0], "n": block["n"].sum(), "factor": r.ravel()}])

    now = picked.mapInPandas(reduce_task, PARTIAL)
    for _ in range(merge_rounds(df) if rounds is None else rounds):
        now = now.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInPandas(merge, PARTIAL)
    rows = sorted(now.collect(), key=lambda r: r["part"])
    if not rows:
        return np.zeros((p, p)), 0
    return stacked([np.reshape(r["factor"], (p, p)) for r in rows], p), sum(r["n"] for r in rows)
