import hashlib
import math
import random
import re

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from llm import pii
from llm.pii import KINDS, pii_spans, redacted, span_text, tree_sql
from llm.queries import op3_pii_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 12 <= len(d) <= 19 and luhn(d))
                or (kind == "phone" and 9 <= len(d) <= 15)
            )
            if good:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def messy(seed, n):
    r = random.Random(seed)
    parts = ["a@b.c", "@", ".", "-", "+", "x", "é", "😀", " ", "\n", "4111 1111 1111 1111", "4111111111111112", "+1 (415) 555-1234",
             "10.0.0.256", "1.2.3.4", "00001.2.3.4", "999999999999999999999.1.1.1", "5", "55", "(at)", "me(at)x.org", "d+e@f-g.h1",
             "%", "415-555-1234", ")", "("]
    return [(i, "".join(r.choice(parts) for _ in range(r.randrange(0, 25)))) for i in range(n)]


def test_base_like_plain_patterns(spark):
    rows = [*messy(1, 800), (900, None), (901, ""), (902, "x" * 50_000 + "1" * 30_000 + " " + "1 " * 20_000),
            (903, "a." * 20_000 + "@" + "b." * 20_000), (900, "mail a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pii_spans(df.withColumn("base", F.lit(1))).select("text", span_text(F.col("base")).alias("s"), span_text(F.col("all")).alias("t")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == brute(r.text), r.text[:200]
        assert set(filter(None, r.s.split(","))) <= set(r.t.split(","))


def test_query_counts_base_spans_of_each_kind(spark, tmp_path):
    rows = [*messy(2, 300), (900, None), (901, ""), (902, "4111111111111111, 4111 1111 1111 1111; a@b.c, d@e.f, 1.2.3.4 and +1 (415) 555-1234")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    for r in op3_pii_spans(spark, str(tmp_path)).collect():
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pii_spans(df).select("text", F.sha2(span_text(F.col("base")), 256).alias("h")).collect()
    assert all(r.h == hashlib.sha256(brute(r.text).encode()).hexdigest() for r in got)


@pytest.mark.parametrize("spans, want", [
    ([(0, 0, 2), (1, 1, 4)], "[EMAIL]efg"), ([(5, 2, 7)], "abcde[CARD]"), ([], "abcdefg"), ([(1, 3, 2), (4, 3, 6)], "a[PHONE]cd[PHONE]g")])
def test_redaction(spark, spans, want):
    df = spark.createDataFrame([("abcdefg", spans)], "t string, s array<struct<start:bigint,kind:int,end:bigint>>")
    assert df.select(redacted(F.col("t"), F.col("s"))).head()[0] == want


def test_empty_table(spark):
    assert pii_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_candidate_is_learnt_from(spark):
    rows = [(i, f"{i}@b.co 1.2.3.{256 + i % 2} " * 50) for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = pii.labelled_candidates(df).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()
    assert {(r.kind, r.label): r.n for r in found if r.kind < 2} == {(0, 1.0): 450 * 50, (1, 0.0): 450 * 50}
    sql, cuts = pii.fit_selector(df)
    assert "CASE" in sql and cuts[0] < math.inf and cuts[1] == math.inf


def test_no_outcomes_select_nothing(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    assert pii.fit_selector(df) == ("0D", [math.inf] * len(KINDS))


def test_tree_sql_is_the_model(spark):
    r = random.Random(3)
    rows = [(float(r.random() > 0.4), [round(r.uniform(-3, 3), 2), float(r.randrange(4)), r.gauss(0, 1)]) for _ in range(400)]
    rows = [(float((f[0] > 0.3) != (f[1] < 2) or y > f[2] + 1), f) for y, f in rows]
    df = spark.createDataFrame(rows, "label double, f array<double>").withColumn("v", array_to_vector("f"))
    model = GBTClassifier(labelCol="label", featuresCol="v", maxIter=7, maxDepth=4, seed=2).fit(df)
    sql = tree_sql(model.toDebugString, list(model.treeWeights))
    got = model.transform(df).select(F.expr(sql).alias("z"), vector_to_array("probability")[1].alias("p")).collect()
    assert len({round(x.z, 6) for x in got}) > 10
    for x in got:
        assert 1 / (1 + math.exp(-2 * x.z)) == pytest.approx(x.p, abs=1e-9)
    assert tree_sql("no trees", []) == "0D"


def test_wider_spans_are_those_above_their_kind_s_threshold(spark, monkeypatch):
    text = "call 415-555-1234 or 020 7946 0958 now, me(at)x.org, ip 10.0.0.256, card 4111111111111111 ok"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    every = df.select(pii.candidates(F.coalesce("text", F.lit("")))[1].alias("c")).select(F.explode("c").alias("c")).select("c.*").collect()
    wide = [c for c in every if not c.strict]
    assert wide
    base = {(r.start, r.kind, r.end) for r in pii_spans(df).head().base}
    for least in (0, 12, 10_000):
        monkeypatch.setattr(pii, "fit_selector", lambda *a, least=least: ("f[0]", [float(least)] * len(KINDS)))
        got = {(s.start, s.kind, s.end) for s in pii_spans(df).where("doc_id = 1").head()["all"]}
        assert got == base | {(c.start, c.kind, c.end) for c in wide if c.end - c.start >= least}
    monkeypatch.setattr(pii, "fit_selector", lambda *a: ("f[0]", [0.0] + [float("inf")] * (len(KINDS) - 1)))
    got = {(s.start, s.kind, s.end) for s in pii_spans(df).where("doc_id = 1").head()["all"]}
    assert got == base | {(c.start, c.kind, c.end) for c in wide if c.kind == 0}
