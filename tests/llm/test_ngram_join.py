import random
import re

import pytest

from llm.ngram_join import ngram_jaccard_join

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    shared = [r.choice(words) for _ in range(60)]
    base = [r.choice(words) for _ in range(150)]
    rows = []
    for i in range(n):
        kind = r.randrange(6)
        if kind == 0:
            t = [r.choice(words) for _ in range(r.randrange(0, 80))]
        elif kind == 1:
            t = shared + [r.choice(words) for _ in range(r.randrange(0, 30))]
        elif kind == 2:  # chains of near copies
            t = base[:]
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(len(t))] = r.choice(words)
        elif kind == 3:
            t = base[: r.randrange(100, 150)]
        elif kind == 4:
            t = rows[r.randrange(len(rows))][1].split() if rows else []
            if t and r.random() < 0.7:
                t[r.randrange(len(t))] = "new"
        else:
            t = [r.choice(words[:3]) for _ in range(r.randrange(0, 7))]
        rows.append((i * 7 + 3, " ".join(t).upper() if r.random() < 0.3 else "\t".join(t)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = corpus(seed, 250)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(df).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    rows = [(5, None, 1), (6, "", 1), (7, " \t", 1), (None, "a b c d e f", 1), (9, "A b c d e f", 1),
            (4, "a  b\nc d e f", 2), (4, "one", 2), (3, "One", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class int")
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_jaccard_join(df).collect())
    assert got == sorted([("5", 0, 5), ("6", 0, 6), ("7", 0, 7), ("None", 2, 4), ("9", 2, 4), ("4", 2, 4),
                          ("4", 1, 3), ("3", 1, 3)])
    assert ngram_jaccard_join(df.where("false")).collect() == []


def test_long_text(spark):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short")]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
