"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters and digits, lower-cased) are hashed to rows of an embedding table, and so
are their first ``PREFIX`` bytes, for words of one stem; a word's embedding is the sum of both.
Filters of several widths slide over them, each filter's greatest answer is kept (max pooling),
and a logistic layer combines them; its output is calibrated on rows it was not fitted on. For
each language a threshold is calibrated as well, for decisions; the score itself sees only text.

Fitting uses whole texts of all labelled rows but the held-out ones. They are dealt into shards of
some ``SHARD_ROWS`` rows; in each of a few rounds tasks learn from one shard after another, all from
the same start, and Spark averages what they learnt. Words of fewer than ``MIN_DOCS`` texts share one
row, so that rare words are not learnt by heart. The driver holds the table, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from llm.shared import cut, ship
from llm.words import ALNUM, words_by_text

SHARD_ROWS = 2000
MIN_DOCS = 4
PREFIX = 6
ROWS = 1 << 16  # numbers of rows are stored in two bytes
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 5
RATE = 0.1
SLAB = 1 << 17  # words scored at a time
DEFAULT_THRESHOLD = 0.7
PAD, RARE = 0, 1  # rows of the table

HELD_OUT = "pmod(crc32(cast(cast({0} AS string) AS binary)), 3)"


@dataclass
class Model:
    tables: list[np.ndarray]  # for each width and place in the filter, answers of every row
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    scale: float
    shift: float
    used: np.ndarray  # rows of common words
    thresholds: dict[str, float]

    def _answers(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greatest answers of the windows that begin in each stretch; rows reach past the last."""
        out, t, n = [], 0, len(rows) - max(WIDTHS) + 1
        bounds = np.stack((starts, ends), axis=1).ravel()
        for w in WIDTHS:
            sums = self.tables[t][rows[:n, 0]] + self.tables[t][rows[:n, 1]]
            for k in range(1, w):
                sums += self.tables[t + k][rows[k : n + k, 0]]
                sums += self.tables[t + k][rows[k : n + k, 1]]
            out.append(np.maximum.reduceat(sums, bounds, axis=0)[::2])
            t += w
        return np.concatenate(out, axis=1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Scores of texts given as rows of the table; a text ends in empty rows, so none sees another."""
        found = np.full((len(texts), len(self.bias)), -np.inf, np.float32)
        gap = np.zeros((max(WIDTHS), 2), np.int64)
        i = 0
        while i < len(texts):
            j, total, parts, starts = i, 0, [], []
            while j < len(texts) and (j == i or total + len(texts[j]) <= SLAB):
                starts.append(total)
                parts += [texts[j], gap]
                total += len(texts[j]) + len(gap)
                j += 1
            if j == i + 1:
                rows = np.concatenate([*parts, gap])
                n = max(1, len(texts[i]))
                for a in range(0, n, SLAB):
                    b = min(n, a + SLAB)
                    part = self._answers(rows[a : b + len(gap)], np.array([0]), np.array([b - a]))
                    found[i] = np.maximum(found[i], part[0])
            else:
                starts = np.array(starts)
                ends = starts + np.maximum(1, [len(x) for x in texts[i:j]])
                found[i:j] = self._answers(np.concatenate([*parts, gap]), starts, ends)
            i = j
        # summed text by text: a product of matrices rounds by how many texts there are
        z = (np.maximum(found + self.bias, 0) * self.weight).sum(axis=1) + self.offset
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -40, 40).astype(np.float64)))


def table_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the two table rows of each word."""
    for hashes in words_by_text(column, ALNUM, prefix=PREFIX):
        yield (hashes % np.uint64(ROWS - 2)).astype(np.int64) + 2


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, shard, toxic, lang, rows)`` of all labelled rows; part 0 is for fitting, 2 for calibration.

    Shards and the order in them follow from the rows, so that the fit does not depend on how the
    table is split.
    """
    clean = (
        labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("part", F.expr(HELD_OUT.format("doc_id"))).where("part <> 1")
    )
    shards = max(1, -(-clean.where("part = 0").count() // SHARD_ROWS))

    own = docs.where(f"{HELD_OUT.format('doc_id')} <> 1").select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = pa.array([r.astype("<u2").tobytes() for r in table_rows(b.column(2))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], packed], ["doc_id", "lang", "rows"])

    # what is dealt are words' rows, less than their text; the labels grow with the documents: no broadcast
    schema = StructType([*own.schema.fields[:2], StructField("rows", BinaryType())])
    joined = own.mapInArrow(run, schema).join(clean.hint("merge"), "doc_id").withColumn("key", F.xxhash64("doc_id"))
    found = joined.select(
        F.col("part").cast("int"), F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key",
        F.col("toxic").cast("int"), "lang", "rows",
    )
    dealt = found.repartition(shards, "shard").sortWithinPartitions("part", "shard", "key", "toxic", "rows")
    return cut(dealt.drop("key"))


@dataclass
class Fitting:
    """What is fitted: row embeddings, filters, and the layer on them, each with its sums of squared steps."""

    used: np.ndarray
    stakes: np.ndarray
    emb: np.ndarray
    g_emb: np.ndarray
    dense: list[np.ndarray]  # filters of each width, bias, weight, offset, then the sums of squares of all these
    touched: np.ndarray = field(default_factory=lambda: np.zeros(ROWS, bool))

    def copy(self) -> Fitting:
        return replace(
            self, emb=self.emb.copy(), g_emb=self.g_emb.copy(), dense=[x.copy() for x in self.dense],
            touched=np.zeros(ROWS, bool),
        )

    def learn(self, texts: list[tuple[int, np.ndarray]], rng: np.random.Generator) -> None:
        """A step by each text, in a random order."""
        emb, g_emb = self.emb, self.g_emb
        half = len(self.dense) // 2
        *filters, bias, weight, offset = self.dense[:half]
        *g_fil, g_bias, g_weight, g_off = self.dense[half:]
        for i in rng.permutation(len(texts)):
            y, rows = texts[i]
            rows = np.concatenate((np.where(self.used[rows], rows, RARE), np.zeros((max(WIDTHS), 2), np.int64)))
            n = max(1, len(rows) - max(WIDTHS))
            picks = [np.zeros(FILTERS, np.int64) for _ in filters]
            best = [np.full(FILTERS, -np.inf, np.float32) for _ in filters]
            for a in range(0, n, SLAB):  # a stretch of the text at a time
                b = min(n, a + SLAB)
                part = rows[a : b + max(WIDTHS) - 1]
                x = emb[part[:, 0]] + emb[part[:, 1]]
                for q, f in enumerate(filters):
                    out = x[: b - a] @ f[0]
                    for k in range(1, len(f)):
                        out = out + x[k : b - a + k] @ f[k]
                    at = out.argmax(axis=0)
                    top = out[at, np.arange(FILTERS)]
                    picks[q] = np.where(top > best[q], a + at, picks[q])
                    best[q] = np.maximum(best[q], top)
            pooled = np.concatenate(best) + bias
            act = np.maximum(pooled, 0)
            err = np.float32(1 / (1 + np.exp(-np.clip(act @ weight + offset[0], -30, 30))) - y) * self.stakes[y]
            d = err * weight * (pooled > 0)
            gw = err * act
            g_weight += gw * gw
            weight -= RATE * gw / np.sqrt(g_weight)
            g_off += err * err
            offset -= RATE * err / np.sqrt(g_off)
            g_bias += d * d
            bias -= RATE * d / np.sqrt(g_bias)
            for q, (f, at) in enumerate(zip(filters, picks, strict=True)):
                dq = d[q * FILTERS : (q + 1) * FILTERS]
                if not dq.any():
                    continue
                for k in range(len(f)):
                    r = rows[at + k]
                    gf = (emb[r[:, 0]] + emb[r[:, 1]]).T * dq
                    ge = dq[:, None] * f[k].T
                    for part in r.T:
                        gp = np.where((part == PAD)[:, None], 0, ge)
                        np.add.at(g_emb, part, (gp * gp).mean(axis=1, keepdims=True))
                        np.add.at(emb, part, -RATE * gp / np.sqrt(g_emb[part]))
                        self.touched[part] = True
                    g_fil[q][k] += gf * gf
                    f[k] -= RATE * gf / np.sqrt(g_fil[q][k])

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbered rows of ``DIM + 1`` values: the table's touched rows, then all that is dense."""
        at = np.flatnonzero(self.touched)
        flat = np.concatenate([x.ravel() for x in self.dense])
        flat = np.concatenate((flat, np.zeros(-len(flat) % (DIM + 1), flat.dtype))).reshape(-1, DIM + 1)
        values = np.concatenate((np.concatenate((self.emb[at], self.g_emb[at]), axis=1), flat)).astype(np.float32)
        return np.concatenate((at, ROWS + np.arange(len(flat)))).astype(np.int32), values

    def unpack(self, slots: np.ndarray, values: np.ndarray) -> None:
        """Take over rows of :meth:`packed`."""
        table = slots < ROWS
        self.emb[slots[table]], self.g_emb[slots[table]] = values[table, :DIM], values[table, DIM:]
        flat = values[~table][np.argsort(slots[~table])].ravel()
        for x in self.dense:
            x[...] = flat[: x.size].reshape(x.shape)
            flat = flat[x.size :]

    def model(self, size: np.ndarray) -> Model:
        """The fitted classifier, not yet calibrated. Where a label lacks, its score is the share of label 1."""
        *filters, bias, weight, offset = self.dense[: len(self.dense) // 2]
        emb = self.emb.copy()
        emb[~self.used] = emb[RARE]
        emb[PAD] = 0
        tables = [(emb @ f[k]).astype(np.float32) for f in filters for k in range(len(f))]
        model = Model(tables, bias, weight, float(offset[0]), 1.0, 0.0, self.used, {})
        if not size.all():
            share = size[1] / max(1, size.sum())
            model.weight = np.zeros_like(weight)
            model.offset = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return model


def beginning(seen: np.ndarray, size: np.ndarray, seed: int = 7) -> Fitting:
    """Where the fit starts, from how many texts of each label hold each row, and how many there are."""
    rng = np.random.default_rng(seed)
    used = seen.sum(axis=0) >= MIN_DOCS
    # a start near the goal: one dimension is a word's log odds of the labels
    size = np.maximum(1, size)
    rate = (seen + 0.5) / (size[:, None] + 1)
    emb = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
    emb[:, 0] = np.clip(np.log(rate[1] / rate[0]), -2, 4) * used / 2
    emb[PAD] = 0
    used[PAD] = True
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] += 1 / len(f)
    bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
    weight = rng.normal(0.1, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    dense = [*filters, bias, weight, np.zeros(1, np.float32)]
    sums = [np.full_like(x, 1e-2) for x in dense]
    # both labels weigh alike
    return Fitting(used, size.sum() / (2 * size), emb, np.full((ROWS, 1), 1e-2, np.float32), [*dense, *sums])


def counted(texts: list[tuple[int, np.ndarray]], seen: np.ndarray) -> None:
    for y, rows in texts:
        seen[y, np.unique(rows)] += 1


def logits(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Log odds of the scores, to a thousandth."""
    p = np.clip(model.scores(texts), 1e-12, 1 - 1e-12)
    return np.round(np.clip(np.log(p / (1 - p)), -12, 12), 3)


def fit(sample: list[tuple], seed: int = 7) -> Model:
    """The fit of ``(part, label, lang, rows)`` that are one shard: part 0 fits, part 2 calibrates."""
    train = [(y, rows) for part, y, _, rows in sample if part == 0]
    seen = np.zeros((2, ROWS))
    counted(train, seen)
    size = np.bincount([y for y, _ in train], minlength=2)
    state = beginning(seen, size, seed)
    for k in range(EPOCHS if size.all() else 0):
        state.learn(train, np.random.default_rng((seed, k, 0)))
    model = state.model(size)
    apart = [(y, lang, rows) for part, y, lang, rows in sample if part == 2]
    z = logits(model, [r[2] for r in apart])
    _calibrate(model, [(y, lang, x, 1) for (y, lang, _), x in zip(apart, z, strict=True)])
    return model


def _texts(b: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
    """Label and table rows of each row of a batch of :func:`labelled_rows`."""
    packed = b.column(b.schema.get_field_index("rows"))
    labels = b.column(b.schema.get_field_index("toxic")).to_pylist()
    return [(y, np.frombuffer(r.as_buffer(), "<u2").reshape(-1, 2)) for y, r in zip(labels, packed, strict=True)]


def fit_rows(rows: DataFrame, seed: int = 7) -> Model:
    """The fit of all :func:`labelled_rows`, shards side by side; the mean of what they learnt starts the next round."""
    sc = rows.sparkSession.sparkContext
    train = rows.where("part = 0").select("shard", "toxic", "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, ROWS), np.int64)
        for b in batches:
            counted(_texts(b), seen)
        y, row = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(row), pa.array(seen[y, row])], ["y", "slot", "n"])

    size = np.zeros(2, np.int64)
    for label, n in train.groupBy("toxic").count().collect():
        size[label] = n
    found = train.mapInArrow(count, "y long, slot long, n long").groupBy("y", "slot").agg(F.sum("n").alias("n"))
    by_row = found.toArrow()  # at most two rows for each row of the table
    seen = np.zeros((2, ROWS))
    seen[by_row["y"].to_numpy(), by_row["slot"].to_numpy()] = by_row["n"].to_numpy()
    state = beginning(seen, size, seed)
    names = [f"v{i}" for i in range(DIM + 1)]
    for k in range(EPOCHS if size.all() else 0):
        shared = sc.broadcast(state)  # a fixed size: the table and the filters

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            def out(own: Fitting) -> pa.RecordBatch:
                slots, values = own.packed()
                return pa.RecordBatch.from_arrays([pa.array(slots), *map(pa.array, values.T.copy())], ["slot", *names])

            own, at = None, None
            for b in batches:
                shards, texts = b.column(0).to_numpy(), _texts(b)
                for shard in np.unique(shards):  # a task's rows come in the order of shards
                    if shard != at:
                        if own is not None:
                            yield out(own)
                        own, at, rng = shared.value.copy(), shard, np.random.default_rng((seed, k, int(shard)))
                    own.learn([texts[i] for i in np.flatnonzero(shards == shard)], rng)
            if own is not None:
                yield out(own)

        learnt = train.mapInArrow(learn, ", ".join(["slot int", *[f"{v} float" for v in names]]))
        mean = learnt.groupBy("slot").agg(*[F.avg(v).alias(v) for v in names]).toArrow()  # as many rows as the table
        state.unpack(mean["slot"].to_numpy(), np.stack([mean[v].to_numpy() for v in names], axis=1))
        shared.destroy()
    model = state.model(size)
    shared = sc.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = logits(shared.value, [r for _, r in _texts(b)])
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(z, pa.float64())], ["toxic", "lang", "z"])

    scored = rows.where("part = 2").select("toxic", "lang", "rows").mapInArrow(score, "toxic int, lang string, z double")
    # scores to a thousandth: a bounded number for each language
    _calibrate(model, [tuple(r) for r in scored.groupBy("toxic", "lang", "z").count().collect()])
    shared.destroy()
    return model


def _calibrate(model: Model, rows: list[tuple]) -> None:
    """Platt scaling on rows apart, then for each language the cut with the fewest errors.

    ``rows`` are label, language, log odds and number. The cut lies midway between the scores that
    it parts; a language without both labels has the default.
    """
    if len({r[0] for r in rows}) < 2:
        return
    rows = sorted(rows, key=lambda r: (r[2], r[0], r[1] or ""))
    y, z, n = (np.array([r[i] for r in rows], float) for i in (0, 2, 3))
    positive, total = float(n @ y), float(n.sum())
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (total - positive + 2))
    a, b = 1.0, 0.0
    for k in range(2000):  # gradient steps, held near the fitted score by a penalty
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        step = 0.2 / (1 + k / 200)
        a = max(0.05, a - step * (float((q - target) * z @ n) / total / 10 + 1e-3 * (a - 1)))
        b -= step * (float((q - target) @ n) / total + 1e-3 * b)
    model.scale, model.shift = a, b
    score = 1 / (1 + np.exp(-np.clip(model.scale * z + b, -40, 40)))
    langs = np.array([r[1] or "" for r in rows])
    for lang in sorted(set(langs)):
        own = langs == lang
        s, place = np.unique(score[own], return_inverse=True)
        ones = np.bincount(place, n[own] * y[own])
        zeros = np.bincount(place, n[own] * (1 - y[own]))
        if not ones.sum() or not zeros.sum():
            continue
        errors = np.concatenate(([0], np.cumsum(ones))) + (zeros.sum() - np.concatenate(([0], np.cumsum(zeros))))
        k = int(errors.argmin())
        low, high = s[k - 1] if k else 0.0, s[k] if k < len(s) else 1.0
        model.thresholds[lang] = float(np.clip((low + high) / 2, 0.3, 0.9))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``rejected``, by the threshold of the row's language.

    Null text counts as empty and is scored as such; a null or unknown language has the default
    threshold. Labels with a null or other value are left out. No rows give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    model = fit_rows(labelled_rows(docs, labels))
    shared = spark.sparkContext.broadcast(model)  # a fixed size: the tables of the filters
    names = [c for c in docs.columns if c not in ("score", "rejected")]
    at = names.index("text")
    plain = docs.select(*[F.col(f"`{c}`") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = m.scores(list(table_rows(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, "score"])

    schema = StructType([*plain.schema, StructField("score", DoubleType())])
    scored = plain.mapInArrow(run, schema)
    limit = F.lit(DEFAULT_THRESHOLD)
    for lang, cutoff in model.thresholds.items():
        limit = F.when(F.col("lang").eqNullSafe(lang or None), F.lit(cutoff)).otherwise(limit)
    return scored.withColumn("rejected", F.col("score") >= limit)
