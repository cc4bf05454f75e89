import hashlib
import random

from llm import fingerprint as fp


def brute(rows):
    """rows (doc_id, text): each against the next in descending doc_id, the plain way."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        a, b, c = (next(fp.fingerprints([x.encode()])) for x in (t, e, nxt))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(a), fp.as_text(b), fp.containment(a, b), fp.containment(a, c))
    return out


def test_like_plain_loop(spark):
    r = random.Random(3)
    words = [f"wörd{k}" for k in range(500)] + ["\0", "😀"]
    rows = [(r.randrange(10**15), " ".join(r.choice(words) for _ in range(r.choice([0, 1, 40, 700])))) for _ in range(150)]
    rows += [(1, None), (2, ""), (-5, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x[0]: tuple(x[1:]) for x in fp.compare_with_next(df, range_rows=20).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    def run(rows):
        return sorted(fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)

    assert run([]) == []
    (one,) = run([(7, "abcdef")])
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    same = run([(7, "abc"), (7, "abc"), (None, "zzz"), (None, None)])
    assert [x.doc_id for x in same] == [7, 7, None, None]
    assert {x.edited_sha256 for x in same if x.doc_id == 7} == {hashlib.sha256(b"aba").hexdigest(), hashlib.sha256(b"ab").hexdigest()}


def test_chunks_resist_shifts():
    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(20_000)).encode()
    moved = b"some words in front" + text
    a, b = fp.fingerprints([text, moved])
    assert fp.containment(a, b) > 0.98
    sizes = a & 0xFFFF
    assert sizes.max() <= fp.MOST and 45 <= sizes.mean() <= 90
