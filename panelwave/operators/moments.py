"""Means and cross-products of many columns in one distributed pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelwave.functions.nullsafe import quoted

MERGE_TASKS = 32
PARTIAL = "part int, grp bigint, n double, w double, mean array<double>, cross array<double>"


@dataclass
class Moments:
    """Row count, total weight, weighted means and centred weighted cross-products."""

    n: float
    w: float
    mean: np.ndarray
    cross: np.ndarray

    def add(self, other: Moments) -> Moments:
        w = self.w + other.w
        if w == 0:
            return Moments(self.n + other.n, 0.0, self.mean, self.cross)
        gap = other.mean - self.mean
        return Moments(
            self.n + other.n,
            w,
            self.mean + gap * (other.w / w),
            self.cross + other.cross + np.outer(gap, gap) * (self.w * other.w / w),
        )

    @staticmethod
    def of(values: np.ndarray, weight: np.ndarray | None = None) -> Moments:
        n = len(values)
        if weight is None:
            mean = values.mean(axis=0)
            centred = values - mean
            return Moments(n, float(n), mean, centred.T @ centred)
        total = weight.sum()
        if total == 0:
            p = values.shape[1]
            return Moments(n, 0.0, np.zeros(p), np.zeros((p, p)))
        mean = (weight @ values) / total
        centred = values - mean
        return Moments(n, float(total), mean, (centred * weight[:, None]).T @ centred)


def packed(group: int, part: int, m: Moments) -> dict:
    upper = np.triu_indices(len(m.mean))
    return {
        "part": part, "grp": group, "n": m.n, "w": m.w, "mean": m.mean, "cross": m.cross[upper],
    }


def unpacked(row, p: int) -> Moments:
    cross = np.zeros((p, p))
    cross[np.triu_indices(p)] = row.cross
    cross = cross + np.triu(cross, 1).T
    return Moments(row.n, row.w, np.asarray(row.mean, dtype=float), cross)


def moments_by(
    df: DataFrame, cols: Sequence[str], weight: str | None = None, by: str | None = None
) -> dict[int, Moments]:
    """:class:`Moments` of ``cols`` for each value of the whole-number expression ``by``.

    Each task reduces its Arrow batches to one p x p block per value of ``by``; blocks
    are merged pairwise (by the rule that keeps them centred, so large means cost no
    digits) in a fixed number of tasks and then on the driver. What moves is
    p * p / 2 numbers per task, never rows, so no key can be too large. ``by`` must
    have few distinct values; rows with nulls have to be gone.
    """
    p = len(cols)
    picked = df.selectExpr(
        *[f"CAST({quoted(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(cols)],
        f"CAST({weight or 'NULL'} AS DOUBLE) AS w",
        f"CAST({by or 0} AS BIGINT) AS grp",
    )
    weighted = weight is not None

    def reduce_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, Moments] = {}
        for batch in batches:
            values = batch.iloc[:, :p].to_numpy(dtype=float)
            weights = batch["w"].to_numpy(dtype=float) if weighted else None
            groups = batch["grp"].to_numpy()
            for g in np.unique(groups):
                here = groups == g
                m = Moments.of(values[here], None if weights is None else weights[here])
                totals[g] = totals[g].add(m) if g in totals else m
        part = TaskContext.get().partitionId() % MERGE_TASKS
        if totals:
            yield pd.DataFrame([packed(int(g), part, m) for g, m in totals.items()])

    def merge(block: pd.DataFrame) -> pd.DataFrame:
        total = None
        for row in block.itertuples():
            m = unpacked(row, p)
            total = m if total is None else total.add(m)
        return pd.DataFrame([packed(int(block["grp"].iloc[0]), int(block["part"].iloc[0]), total)])

    merged = picked.mapInPandas(reduce_task, PARTIAL).groupBy("part", "grp").applyInPandas(
        merge, PARTIAL
    )
    out: dict[int, Moments] = {}
    for row in sorted(merged.collect(), key=lambda r: (r["grp"], r["part"])):
        m = unpacked(row, p)
        out[row["grp"]] = out[row["grp"]].add(m) if row["grp"] in out else m
    return out


def moments(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> Moments:
    """:class:`Moments` of ``cols`` over all rows; an error if there are none."""
    found = moments_by(df, cols, weight)
    if not found:
        raise ValueError("no complete rows to fit")
    return found[0]
