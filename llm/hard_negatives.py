"""Hard negatives by exact integer scores, with an angular triangle filter.

Rows are dealt by a hash into blocks, anchors as well, and every pair of blocks is one group.
Inside a group rows lie by label, nearest reference direction and angle to it, in windows of
consecutive rows. A window stores the range of its rows' angles to every reference direction and
of their norms. An anchor's angles to the same directions bound its angle to all rows of a window
(no less than the gap between the angles, no more than their sum), and with the norms its scores;
the bounds are widened for rounding. Only windows whose bounds reach an anchor's wanted scores get
integer dot products, which are exact (``limbs``).

First every anchor finds its positives, wanted scores being those above the last one kept so far.
These give each anchor and positive a range of scores for the second pass over the same blocks.
Groups return a few rows for each anchor (and positive), from which the first ones are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.limbs import Split
from llm.shared import ship, stored
from llm.vectors import SCALE, first_width, integer_rows, is_whole

POSITIVES = 5
NEGATIVES = 3
BLOCK = 1 << 14  # rows of a block
ANCHORS = 1 << 10  # anchors of a block
RUN = 128  # rows of a window
DIRECTIONS = 16
SAMPLE = 1024  # rows that the reference directions are fitted on
ANGLE_SLACK = 1e-6  # far beyond the rounding of an arc cosine
SCORE_SLACK = 1e-9  # of the product of the norms

NONE = -(1 << 63)


def reference_directions(x: np.ndarray, count: int = DIRECTIONS, rounds: int = 5) -> np.ndarray:
    """Unit vectors in the middle of groups of ``x`` (spherical k-means from rows far apart)."""
    x = x[np.any(x != 0, axis=1)]
    if len(x) == 0:
        return np.zeros((0, x.shape[1]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    picked = [0]
    near = u @ u[0]
    while len(picked) < min(count, len(u)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, u @ u[picked[-1]])
    centre = u[picked]
    for _ in range(rounds):
        of = (u @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, of, u)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, total / np.maximum(size, 1e-300), centre)
    return centre


def angles(x: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to the reference directions; a right angle for a zero row, whose scores are 0."""
    cosine = (x @ directions.T) / np.where(norm > 0, norm, 1.0)[:, None]
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Windows:
    """Rows of a group in windows, and bounds on their scores."""

    def __init__(self, row, vec_id, label, x, directions):
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        angle = angles(x, norm, directions)
        at = angle.argmin(axis=1) if angle.shape[1] else np.zeros(len(x), np.int64)
        own = angle[np.arange(len(x)), at] if angle.shape[1] else np.zeros(len(x))
        order = np.lexsort((own, at, label))
        self.row, self.vec_id, label = row[order], vec_id[order], label[order]
        norm, angle = norm[order], angle[order]
        self.x = Split(x[order])
        bounds = np.flatnonzero(np.diff(label)) + 1
        first = [np.arange(a, b, RUN) for a, b in zip([0, *bounds], [*bounds, len(label)])]
        self.first = np.concatenate(first)
        self.stop = np.append(self.first[1:], len(label))
        self.label = label[self.first]
        self.near, self.far = (f.reduceat(angle, self.first, axis=0) for f in (np.minimum, np.maximum))
        self.least, self.most = (f.reduceat(norm, self.first) for f in (np.minimum, np.maximum))

    def scores_between(self, angle: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every anchor and window, no score is below the first or above the second array."""
        low = np.zeros((len(angle), len(self.first)))
        high = np.full(low.shape, np.pi)
        for j in range(angle.shape[1]):
            s, a, b = angle[:, j, None], self.near[:, j], self.far[:, j]
            low = np.maximum(low, np.maximum(a - s, s - b))
            reach = np.where(s + b <= np.pi, s + b, np.where(s + a >= np.pi, 2 * np.pi - s - a, np.pi))
            high = np.minimum(high, reach)
        best = np.cos(np.maximum(low - ANGLE_SLACK, 0))
        worst = np.cos(np.minimum(high + ANGLE_SLACK, np.pi))
        slack = SCORE_SLACK * norm[:, None] * self.most + SCORE_SLACK
        upper = norm[:, None] * np.where(best >= 0, self.most, self.least) * best + slack
        lower = norm[:, None] * np.where(worst >= 0, self.least, self.most) * worst - slack
        return lower, upper


class First:
    """The first ``k`` candidates of every key: higher scores first, then smaller ids, then rows."""

    def __init__(self, keys: int, k: int):
        self.score = np.full((keys, k), NONE)
        self.vec_id = np.zeros((keys, k), np.int64)
        self.row = np.zeros((keys, k), np.int64)

    @property
    def last(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, key, score, vec_id, row) -> None:
        if len(key) == 0:
            return
        k = self.score.shape[1]
        held = np.unique(key)
        both = [np.concatenate((np.repeat(held, k), key))]
        both += [
            np.concatenate((kept[held].ravel(), new))
            for kept, new in ((self.score, score), (self.vec_id, vec_id), (self.row, row))
        ]
        # scores fall as their complements rise
        order = np.lexsort((both[3], both[2], ~both[1], both[0]))
        key, *rest = (b[order] for b in both)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        kept = rank < k
        for into, values in zip((self.score, self.vec_id, self.row), rest):
            into[key[kept], rank[kept]] = values[kept]

    def columns(self) -> tuple[np.ndarray, ...]:
        key, _ = here = np.nonzero(self.score > NONE)
        return key, self.score[here], self.vec_id[here], self.row[here]


class Anchors:
    def __init__(self, row, label, x, directions):
        self.row, self.label = row, label
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.angle = angles(x, self.norm, directions)
        self.x = Split(x)


def find_positives(windows: Windows, anchors: Anchors, k: int) -> First:
    """The first ``k`` other rows of an anchor's label. The most promising window comes first."""
    best = First(len(anchors.row), k)
    _, upper = windows.scores_between(anchors.angle, anchors.norm)
    upper = np.where(windows.label == anchors.label[:, None], upper, -np.inf)
    done = np.zeros(upper.shape, bool)
    top = upper.argmax(axis=1)
    for begin in (True, False):
        for w in range(len(windows.first)):
            wanted = upper[:, w] > -np.inf
            wanted &= top == w if begin else ~done[:, w] & (upper[:, w] >= best.last)
            who = np.flatnonzero(wanted)
            if len(who) == 0:
                continue
            done[who, w] = True
            part = slice(windows.first[w], windows.stop[w])
            score = anchors.x.take(who) @ windows.x.take(part)
            fine = (score >= best.last[who, None]) & (windows.row[part] != anchors.row[who, None])
            a, i = np.nonzero(fine)
            best.offer(who[a], score[a, i], windows.vec_id[part][i], windows.row[part][i])
    return best


def find_negatives(windows: Windows, anchors: Anchors, low: np.ndarray, high: np.ndarray, k: int) -> First:
    """The first ``k`` rows of other labels with scores from ``low`` to ``high`` (anchor, range)."""
    count, ranges = low.shape
    best = First(count * ranges, k)
    lower, upper = windows.scores_between(anchors.angle, anchors.norm)
    for w in range(len(windows.first)):
        least = np.maximum(low, best.last.reshape(count, ranges))
        wanted = (upper[:, w, None] >= least) & (lower[:, w, None] <= high) & (low <= high)
        wanted &= (anchors.label != windows.label[w])[:, None]
        who = np.flatnonzero(wanted.any(axis=1))
        if len(who) == 0:
            continue
        part = slice(windows.first[w], windows.stop[w])
        score = anchors.x.take(who) @ windows.x.take(part)
        # what may count for any range, then range by range
        bottom = np.where(wanted[who], least[who], np.iinfo(np.int64).max).min(axis=1)[:, None]
        top = np.where(wanted[who], high[who], NONE).max(axis=1)[:, None]
        a, i = np.nonzero((score >= bottom) & (score <= top))
        score, a = score[a, i], who[a]
        fits = (score[:, None] >= least[a]) & (score[:, None] <= high[a]) & wanted[a]
        at, r = np.nonzero(fits)
        i = i[at] + windows.first[w]
        best.offer(a[at] * ranges + r, score[at], windows.vec_id[i], windows.row[i])
    return best


def _prepared(rows: DataFrame, width: int) -> DataFrame:
    """``(row, vec_id, label, x)`` of distinct rows that take part; ``x`` as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, fits, x = integer_rows(b.column(2), width)
            size = 4 * width
            raw = x.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(fits), b.column(1).take(fits),
                 pa.array([raw[k * size : (k + 1) * size] for k in range(len(fits))], pa.binary())],
                ["vec_id", "label", "x"],
            )

    whole = rows.mapInArrow(run, "vec_id long, label long, x binary").distinct()
    return stored(whole.withColumn("row", F.monotonically_increasing_id()))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _longs(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def hard_negatives(
    rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = 50, most: int = 95, block: int = BLOCK, anchor_block: int = ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose vec_id is divisible by ``every``. A score is the dot product of
    vectors of floor(256 x). A positive is one of the first ``positives`` other rows of the anchor's
    label; its negatives are the first ``negatives`` rows of other labels whose score lies between
    ``least`` and ``most`` percent of the positive's. Higher scores come first, then smaller vec_ids.

    Rows with a null vec_id, label or vector, or null or non-finite components, take no part, nor
    do vectors not as long as that of the least vec_id that does. Rows repeated whole count once;
    rows that share a vec_id but not the label or vector are rows of their own, and may all be
    anchors. Scores that could leave 64 bits raise an OverflowError. No rows give no rows; other
    columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"
    )
    width = first_width(rows, "vec_id", "embedding")
    if not width:
        return spark.createDataFrame([], schema)
    seen = (
        rows.where(is_whole("embedding")).where(F.size("embedding") == width)
        .orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").collect()
    )
    directions = reference_directions(np.floor(SCALE * np.array([r[0] for r in seen], np.float64)))
    data = _prepared(rows, width)
    anchors = data.where(F.col("vec_id") % every == 0)
    n_rows, n_anchors = data.count(), anchors.count()
    blocks, anchor_blocks = max(1, -(-n_rows // block)), max(1, -(-n_anchors // anchor_block))

    def dealt(df: DataFrame, own: int, other: int, cell: str) -> DataFrame:
        """Each row in its block, once for every block of the other side."""
        return (
            df.withColumn("own", F.pmod(F.xxhash64("row"), F.lit(own)))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
            .withColumn("cell", F.expr(cell)).drop("own", "other")
        )

    targets = dealt(data, blocks, anchor_blocks, f"own * {anchor_blocks} + other")

    def grouped(asking: DataFrame):
        renamed = asking.toDF(*asking.columns)  # columns of its own, not those of the targets
        askers = dealt(renamed, anchor_blocks, blocks, f"other * {anchor_blocks} + own")
        return targets.groupBy("cell").cogroup(askers.groupBy("cell"))

    def both(left: pa.Table, right: pa.Table) -> tuple[Windows, Anchors]:
        return (
            Windows(*(_longs(left, c) for c in ("row", "vec_id", "label")), _matrix(left.column("x"), width), directions),
            Anchors(_longs(right, "row"), _longs(right, "label"), _matrix(right.column("x"), width), directions),
        )

    def positive(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "positive_id", "positive", "score"]
        if len(left) == 0 or len(right) == 0:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        windows, asking = both(left, right)
        key, score, vec_id, row = find_positives(windows, asking, positives).columns()
        return pa.table([asking.row[key], vec_id, row, score], names)

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor", "place", "negative_id", "negative", "score"]
        if len(left) == 0 or len(right) == 0:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        windows, asking = both(left, right)
        low, high = np.ones((len(right), positives), np.int64), np.zeros((len(right), positives), np.int64)
        for i, found in enumerate(right.column("scores").to_pylist()):
            for k, s in enumerate(found):
                low[i, k], high[i, k] = -(-least * s // 100), most * s // 100
        key, score, vec_id, row = find_negatives(windows, asking, low, high, negatives).columns()
        return pa.table([asking.row[key // positives], key % positives, vec_id, row, score], names)

    near = grouped(anchors).applyInArrow(positive, "anchor long, positive_id long, positive long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive")
    near = stored(near.withColumn("place", F.row_number().over(first) - 1).where(F.col("place") < positives))
    # at most ``positives`` scores for an anchor
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("found"))
    asking = anchors.join(scores.withColumnRenamed("anchor", "row"), "row").withColumn("scores", F.col("found.score"))
    hard = grouped(asking.drop("found")).applyInArrow(
        negative, "anchor long, place long, negative_id long, negative long, score long"
    )
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative_id", "negative")
    hard = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    named = near.withColumnRenamed("score", "positive_score").join(
        hard.withColumnRenamed("score", "negative_score"), ["anchor", "place"]
    )
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return named.join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
