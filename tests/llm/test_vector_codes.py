import hashlib

import numpy as np
import pytest

from llm import limbs, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, total long"


@pytest.mark.parametrize("size", [1, 300, 1 << 20, 1 << 27])
@pytest.mark.parametrize("bits", [None, 5, 13])
def test_products_are_exact(size, bits):
    r = np.random.default_rng(size)
    a, b = r.integers(-size, size + 1, (40, 9)), r.integers(-size, size + 1, (30, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert limbs.exact_products(a, b, bits).tolist() == want


def test_products_below_the_largest_float_integer():
    for width in (1, 3, 64, 1000):
        bits = limbs.limb_bits(width)
        assert width * (1 << (bits - 1)) ** 2 < 1 << 53
    x = np.full((1, 4), (1 << 30) - 1)
    assert len(limbs.limbs(x, limbs.limb_bits(4))) == 2
    assert limbs.exact_products(x, x)[0, 0] == 4 * ((1 << 30) - 1) ** 2
    with pytest.raises(OverflowError):
        limbs.exact_products(x * 4, x * 4)


def plain(rows, parts, entries, rounds):
    """The same by loops over Python integers."""
    kept = [
        (i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label, *_ in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2])
    d = width // parts
    fits = [r for r in kept if len(r[2]) == width]
    cutup = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    books = [[cutup(r[2])[p] for r in fits[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for r in fits:
                held[best(cutup(r[2])[p], books[p])[1]].append(cutup(r[2])[p])
            new.append([[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])])
        books = new
    out = []
    for i, label, v in kept:
        if len(v) == width:
            found = [best(x, books[p]) for p, x in enumerate(cutup(v))]
            out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(f for f, _ in found)))
        else:
            out.append((i, label, None, None))
    totals = {}
    for _, label, _, e in out:
        totals[label] = (totals.get(label) or 0) + e if e is not None else totals.get(label)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[label], digest) for i, label, c, e in out), key=str)


def rows_of(seed, scale=1.0):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(r.normal(size=8) * scale)], int(r.integers(4))) for i in range(5, 200)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 1), (2, [nan] + [1.0] * 7, 1), (3, [None] + [1.0] * 7, 1), (4, [-inf] + [1.0] * 7, None),
             (300, [0.0] * 8, None), (301, [1.0] * 8, None), (302, [1.0] * 4, 2), (303, [], 9), (None, [0.5] * 8, 1)]
    rows += [(400, [0.25] * 8, 3)] * 60 + [(500 + i, [0.25] * 8, 3) for i in range(5)]
    return [(*x, 0, 0) for x in rows]


@pytest.mark.parametrize("scale, entries", [(1.0, 16), (0.002, 64), (40_000.0, 8)])
def test_like_plain_loops(spark, scale, entries):
    rows = rows_of(entries, scale)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in vector_codes.compress(df, 4, entries, 2).collect()), key=str)
    assert got == plain(rows, 4, entries, 2)


def test_edges(spark):
    none = spark.createDataFrame([(1, None, 1, 0, 0)], SCHEMA)
    assert vector_codes.compress(none).collect() == []
    assert vector_codes.compress(none.where("false")).collect() == []
    one = spark.createDataFrame([(1, [1.0] * 16, None, 0, 0)], SCHEMA)
    (row,) = vector_codes.compress(one).collect()
    assert (row.code, row.error, row.label_error) == ("00" * 16, 0, 0)
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 15, None, 0, 0)], SCHEMA))
