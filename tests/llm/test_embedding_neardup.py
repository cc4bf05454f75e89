import tracemalloc

import numpy as np
import pytest

from llm import embedding_neardup as en

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = (label, np.array(v, np.float32).astype(float))
    links = {i: set() for i, _, _ in rows}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
    comp = {}
    for i in sorted(links):
        if i in comp:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in comp:
                comp[k] = i
                todo += links[k]
    return {i: (len(links[i]), comp[i], comp[i] == i) for i in links}


def vectors(seed, n):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 6, 16))
    rows = []
    for i in range(n):
        v = centres[r.integers(len(centres))] + r.normal(size=16) * r.choice([0.0, 0.1, 0.25])
        rows.append((int(i * 5 + 2), [float(x) for x in np.float32(v * r.choice([1, 2.5]))], int(r.integers(3))))
    return rows


@pytest.mark.parametrize("shard", [1000, 40])
def test_like_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(en, "SHARD", shard)
    rows = vectors(4, 400)
    nan, inf = float("nan"), float("inf")
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [nan] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1),
             (9005, [inf] + [1.0] * 15, 1), (9006, rows[0][1], None), (9007, [1.0, 2.0], 1), (9008, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS node", "2 AS v").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in en.near_duplicates(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    found, total = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found >= 0.97 * total
    assert all(got[i][0] <= want[i][0] for i in want)
    if found == total:
        assert got == want


def test_dense_group_and_edges(spark, monkeypatch):
    monkeypatch.setattr(en, "SHARD", 40)
    r = np.random.default_rng(1)
    base = r.normal(size=16)
    rows = [(i, [float(x) for x in np.float32(base + r.normal(size=16) * 1e-4)], 1) for i in range(150)] + [(None, [1.0] * 16, 1)]
    got = en.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 151
    assert sum(r.n_links for r in got) >= 0.97 * 150 * 149
    (none,) = [r for r in got if r.vec_id is None]
    assert (none.n_links, none.component_id, none.kept) == (0, None, False)
    assert en.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_of_every_vector_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(en, "SHARD", 60)
    rows = vectors(9, 900)
    got = {r.vec_id: r for r in en.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    shares = [got[i].n_links / n for i, (n, _, _) in want.items() if n]
    assert len(shares) > 100 and np.mean(shares) >= 0.97 and all(s <= 1 for s in shares)
    assert {r.recall for r in got.values()} != {0.0}


def test_exact_where_recall_stays_short(spark, monkeypatch):
    monkeypatch.setattr(en, "SHARD", 60)
    monkeypatch.setattr(en, "RECALL", 1.1)
    monkeypatch.setattr(en, "MOST_REPEATS", 2)
    rows = vectors(5, 500)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in en.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_equal_vectors_are_one_node(spark):
    base = [float(x) for x in np.random.default_rng(2).normal(size=16)]
    rows = [(i, base, 1) for i in range(3000)] + [(5000, [2 * x for x in base], 1), (5001, base, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = en.keyed_vectors(df).where("k IS NOT NULL").groupBy("label", "k").count()
    assert nodes.count() == 3
    got = {r.vec_id: (r.n_links, r.component_id) for r in en.near_duplicates(df).collect()}
    assert got[0] == got[2999] == got[5000] == (3000, 0) and got[5001] == (0, 5001)


def test_search_of_a_dense_group_in_bounded_memory():
    r = np.random.default_rng(7)
    x = r.normal(size=64) + 0.05 * r.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    table = en.adjacency(x)
    assert table.shape[1] <= max(en.WIDEST, en.DEGREE)
    inside = en.range_search(x, table, [0], 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert inside.sum() == 1000 * 999 and peak < 200e6
    far = r.normal(size=(400, 64))
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    both = np.concatenate((x[:200], far))
    inside = en.range_search(both, en.adjacency(both), [500], 0.93)
    want = both @ both.T >= 0.93
    np.fill_diagonal(want, False)
    assert inside.sum() >= 0.97 * want.sum() and not (inside & ~want).any()


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[1.0, 0, 0], [0.99, 0.14, 0], [0.985, 0.17, 0], [0.98, 0, 0.2], [0, 1, 0]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -2)
    kept = en.prune(near, np.array([[1, 2, 3, -1]] * 5), 3)[0]
    assert kept.tolist() == [1, 3, -1]  # 2 lies behind 1
