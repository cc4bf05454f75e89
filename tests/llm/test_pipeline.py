import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm import quality, toxicity
from llm.ngram_join import ngram_jaccard_join
from llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    got = QUERIES["op6_conv_toxicity"](spark, SF)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "toxic", "doc_id", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.88 * len(rows)
    assert sum(r.predicted and not r.toxic for r in rows) <= 0.03 * len(rows)


def test_toxicity_learns_words_and_ignores_columns(spark):
    bad = [(i, f"some text number {i} with vile words and more", "en", 1) for i in range(120)]
    good = [(i, f"some text number {i} with kind words and more", "en", 0) for i in range(120, 240)]
    odd = [(900, None, None, None), (901, "", "xx", None), (902, "long " * 200_000 + "vile", "en", None), (None, "vile", "en", None), (5, "kind", "en", None)]
    df = spark.createDataFrame(bad + good + odd, "doc_id long, text string, lang string, toxic int")
    labels = df.where("toxic IS NOT NULL").select("doc_id", "toxic").unionAll(spark.createDataFrame([(900, None), (None, 1)], "doc_id long, toxic int"))
    docs = df.drop("toxic").withColumn("score", F.lit("x"))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(bad + good + odd)
    for r in got:
        if r.text and r.doc_id is not None and r.doc_id < 240 and r.text != "kind":
            assert (r.score >= 0.7) == (r.doc_id < 120)
    assert {r.score for r in got if not r.text} == {next(r.score for r in got if r.doc_id == 901)}
    swapped = toxicity.toxicity(docs.withColumn("lang", F.lit("de")).repartition(3), labels).select("text", "score").collect()
    assert {(r.text, round(r.score, 9)) for r in swapped} == {(r.text, round(r.score, 9)) for r in got}
    assert toxicity.toxicity(docs.where("false"), labels.where("false")).collect() == []


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 100)
    ids = [i for i in range(9000) if zlib.crc32(str(i).encode()) % 3 == 0]
    rows = [(i, "plain words " + ("vile" if i % 2 else "kind") + f" {i % 7}", "en", i % 2) for i in ids]
    rows[5] = (ids[5], "kind " * 30_000, "en", 0)  # a long text is learnt from whole
    apart = [(9000 + i, "some vile" if i % 2 else "some kind", "en", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows + apart, "doc_id long, text string, lang string, toxic int").repartition(5)
    found = toxicity.labelled_rows(df.drop("toxic"), df.select("doc_id", "toxic"))
    kept = found.where("part = 0").selectExpr("shard", "toxic", "octet_length(rows) AS n").collect()
    assert sum(r.toxic == 1 for r in kept) >= sum(r[3] for r in rows)
    assert len(kept) >= len(rows) and max(r.n for r in kept) == 4 * 30_000
    assert len({r.shard for r in kept}) > 20
    model = toxicity.fit_rows(found)
    texts = list(toxicity.table_rows(pa.array(["such vile things", "such kind things"])))
    bad, good = model.scores(texts)
    assert bad > 0.7 > 0.3 > good


def test_shards_on_spark_learn_as_one_does_here(spark):
    r = np.random.default_rng(2)
    sample = [(p, y, "en", (r.integers(2, 50, (4 + i % 5, 2)) + 40 * y).astype("<u2")) for p in (0, 2) for i in range(30) for y in (0, 1)]
    rows = [(p, 0, y, lang, x.tobytes()) for p, y, lang, x in sample]
    df = spark.createDataFrame(rows, "part int, shard int, toxic int, lang string, rows binary").coalesce(1)
    got, want = toxicity.fit_rows(df), toxicity.fit(sample)
    texts = [x for _, _, _, x in sample]
    assert np.allclose(got.scores(texts), want.scores(texts), atol=1e-4) and got.thresholds.keys() == want.thresholds.keys()


def test_long_text_is_scored_whole(monkeypatch):
    sample = [(p, y, "en", np.full((3 + y, 2), 5 + y)) for p in (0, 2) for y in (0, 1) for _ in range(20)]
    model = toxicity.fit(sample)
    r = np.random.default_rng(1)
    texts = [r.integers(2, 60, (n, 2)) for n in (0, 1, 7, 500, 1200)]
    want = model.scores(texts)
    monkeypatch.setattr(toxicity, "SLAB", 16)
    assert np.allclose(model.scores(texts), want)


def test_text_without_words_alone(monkeypatch):
    model = toxicity.fit([(p, y, "en", np.full((3 + y, 2), 5 + y)) for p in (0, 2) for y in (0, 1) for _ in range(20)])
    none, long = np.zeros((0, 2), np.int64), np.full((50, 2), 6)
    want = model.scores([none, long, none])
    assert model.scores([]).shape == (0,) and model.scores([none]) == want[:1]
    monkeypatch.setattr(toxicity, "SLAB", 16)
    assert np.allclose(model.scores([long, none]), want[1:]) and np.allclose(model.scores([none, long, none]), want)
    assert np.allclose(model.scores([long, none, long]), want[[1, 0, 1]])


def test_kth_greatest(spark):
    values = [1.0, 2.0, 2.0, 2.0, 3.5, -7.0, 1e9, 2.0 + 1e-12]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values) + 1):
        assert quality.kth_greatest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_greatest(df, "v", 0) == math.inf and quality.kth_greatest(df.where("false"), "v", 3) == math.inf


def test_quality_like_plain_counts(spark, tables):
    docs, labels = tables
    few = docs.where("doc_id < 60").unionAll(spark.createDataFrame([(60, None, "en", "s", 0), (61, "", None, None, None)], docs.schema))
    got = quality.quality_resample(few, labels, k=20).collect()
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    assert sum(r.selected for r in got) == 20 and all(r.selected == (r.gumbel_key >= keys[19]) for r in got)
    good = {r.doc_id for r in labels.where("quality = 1").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).collect()}
    counts = np.zeros((2, quality.BUCKETS))
    parts = {r.doc_id: next(quality.ngram_buckets(pa.array([r.text]))) for r in got}
    for i, b in parts.items():
        for k in (0, 1) if i in good else (0,):
            np.add.at(counts[k], b, 1)
    ratio = quality.log_ratio(counts)
    for r in got:
        want = quality.SCALE * ratio[parts[r.doc_id]].mean() if len(parts[r.doc_id]) else 0.0
        assert abs(r.log_weight - want) < 1e-9
    assert quality.quality_resample(docs.where("false"), labels).collect() == []


def test_quality_keeps_good_rows(spark, tables):
    docs, labels = tables
    rows = quality.quality_resample(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("int"))).collect()
    share = dict(rows)
    assert share[1] > 0.95 and share[0] < 0.35


def test_pipeline_stages(spark, tables):
    docs, labels = tables
    toxic, good, unique, clean, packed = docs, None, None, None, None
    stages = dict(corpus_pipeline.STAGES)
    toxic = stages["toxicity"](spark, docs, SF)
    assert toxic.columns == docs.columns
    gone = docs.join(toxic, "doc_id", "left_anti").join(labels, "doc_id").agg(F.sum("toxic"), F.count("*")).head()
    assert gone[0] >= 0.7 * gone[1]
    good = stages["quality"](spark, toxic, SF)
    unique = stages["ngram_join"](spark, good, SF).cache()
    rows = ngram_jaccard_join(good).collect()
    assert {r.doc_id for r in unique.collect()} == {r.component_id for r in rows}
    clean = stages["pii"](spark, unique, SF).cache()
    assert clean.columns == docs.columns and clean.count() == unique.count()
    assert clean.where(r"text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+\\.[a-z]'").count() == 0
    assert clean.where("n_chars <> char_length(text)").count() == 0
    packed = stages["packing"](spark, clean, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.select("doc_id").collect()}


OWN = {"score": "x", "rejected": "no", "log_weight": "w", "gumbel_key": "g", "selected": "s", "base": "b", "all": "a", "row": "r",
       "sequence": "q", "component_id": "c"}


def test_columns_of_the_caller_stay(spark, tables):
    docs = tables[0].where("doc_id < 150")
    for name, value in OWN.items():
        docs = docs.withColumn(name, F.lit(value))
    kept = docs.drop("n_chars", "lang")
    for stage in ("toxicity", "quality", "ngram_join", "pii"):
        for df in (docs, kept):
            got = dict(corpus_pipeline.STAGES)[stage](spark, df, SF)
            assert got.columns == df.columns
            assert {tuple(r) for r in got.select(*OWN).distinct().collect()} == {tuple(OWN.values())}


def test_near_copies_go_by_row(spark):
    text = " ".join(f"w{i}" for i in range(200))
    other = " ".join(f"v{i}" for i in range(200))
    rows = [(1, text), (2, text), (2, other), (3, text + " end"), (None, text), (None, other), (None, "alone"), (4, None), (4, ""), (1, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()), key=str)
    assert got == sorted([(1, text), (2, other), (None, "alone"), (4, None), (4, "")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, df.where("false"), SF).collect() == []


def test_run_applies_the_stages(spark):
    packed = corpus_pipeline.run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert set(packed.doc_id) == {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    assert sorted(packed.ids_crc32) == sorted(r.ids_crc32 for r in docs.select("ids_crc32").collect())


def test_scores_like_a_plain_convolution():
    r = np.random.default_rng(4)
    sample = [(p, y, "en", r.integers(2, 50, (5 + 3 * y, 2)) + 40 * y) for p in (0, 2) for y in (0, 1) for _ in range(15)]
    model = toxicity.fit(sample)
    texts = [r.integers(2, 90, (n, 2)) for n in (1, 2, 3, 9, 40)] + [np.zeros((0, 2), np.int64)]
    for text, got in zip(texts, model.scores(texts)):
        answers, t = [], 0
        for w in toxicity.WIDTHS:
            best = None
            for i in range(max(1, len(text))):  # words beyond the end are the empty row
                total = 0
                for k in range(w):
                    a, b = text[i + k] if i + k < len(text) else (0, 0)
                    total = total + model.tables[t + k][a] + model.tables[t + k][b]
                best = total if best is None else np.maximum(best, total)
            answers.append(best)
            t += w
        z = np.maximum(np.concatenate(answers) + model.bias, 0) @ model.weight + model.offset
        assert got == pytest.approx(1 / (1 + math.exp(-(model.scale * z + model.shift))), abs=1e-5)
