import numpy as np
import pytest

from llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row long, score int"


def brute(rows, every=50):
    kept = set()
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.add((i, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    width = len(min(kept, key=lambda r: (r[0], r[2]))[2])
    kept = [r for r in kept if len(r[2]) == width]
    out = []
    for a in (r for r in kept if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1], r != a) for r in kept)
        for ps, pid, *_ in [s for s in scored if s[2] == a[1] and s[3]][:5]:
            hard = [(s, i) for s, i, label, _ in scored if label != a[1] and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a[0], pid, k + 1, i, -ps, -s) for k, (s, i) in enumerate(hard[:3])]
    return sorted(out)


def rows_of(seed, n, dims=6, spread=0.6, scale=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dims))
    rows = []
    for i in range(n):
        v = (centres[r.integers(5)] + spread * r.normal(size=dims)) * r.choice([0.3, 1.0, 2.0]) * scale
        rows.append((int(r.integers(4 * n)), [float(x) for x in np.float32(np.round(v, 1))], int(r.integers(4))))
    nan, inf = float("nan"), float("inf")
    rows += [(0, [0.0] * dims, 1), (50, [0.0] * dims, 1), (100, [1.0] * dims, None), (150, None, 1), (200, [nan] * dims, 2),
             (250, [1.0] * (dims - 1) + [None], 2), (300, [inf] + [0.0] * (dims - 1), 3), (None, [1.0] * dims, 1),
             (350, [1.0] * (dims + 1), 1), (351, [], 1)]
    rows += [(400, [1.0] * dims, 1)] * 40 + [(401 + k, [0.5] * dims, 2) for k in range(10)]
    return [(*x, 7, 7) for x in rows]


@pytest.mark.parametrize("seed, spread, block, run", [(1, 0.6, 1 << 14, 128), (2, 0.05, 100, 8), (3, 2.0, 64, 4)])
def test_like_brute_force(spark, monkeypatch, seed, spread, block, run):
    monkeypatch.setattr(hn, "RUN", run)
    rows = rows_of(seed, 500, spread=spread)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hn.hard_negatives(df, every=10, block=block, anchor_block=max(4, block // 8)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    assert len(got) > 100


def test_bounds_hold(monkeypatch):
    monkeypatch.setattr(hn, "RUN", 16)
    r = np.random.default_rng(5)
    for spread in (0.0, 0.01, 0.3, 3.0):
        x = np.floor(256 * (r.normal(size=(1, 5)) * r.choice([-1, 1], (700, 1)) + spread * r.normal(size=(700, 5)))).astype(np.int64)
        x[::50] = 0
        directions = hn.reference_directions(x.astype(float))
        windows = hn.Windows(np.arange(700), np.arange(700), r.integers(0, 3, 700), x, directions)
        anchors = hn.Anchors(np.arange(80), np.zeros(80, np.int64), x[:80], directions)
        low, high = windows.scores_between(anchors.angle, anchors.norm)
        score = anchors.x @ windows.x
        for w, (a, b) in enumerate(zip(windows.first, windows.stop)):
            assert (score[:, a:b] >= low[:, w, None]).all() and (score[:, a:b] <= high[:, w, None]).all()
        if 0 < spread < 0.1:  # rows of two opposite directions: the filter tells them apart
            assert np.mean(high < 0) > 0.1


def test_edges(spark):
    none = spark.createDataFrame([(50, None, 1, 0, 0)], SCHEMA)
    assert hn.hard_negatives(none).collect() == []
    assert hn.hard_negatives(none.where("false")).collect() == []
    alone = spark.createDataFrame([(50, [1.0, 1.0], 1, 0, 0), (51, [0.8, 0.8], 2, 0, 0)], SCHEMA)
    assert hn.hard_negatives(alone).collect() == []
    no_anchor = spark.createDataFrame([(51, [1.0, 1.0], 1, 0, 0), (52, [0.8, 0.8], 2, 0, 0)], SCHEMA)
    assert hn.hard_negatives(no_anchor).collect() == []
