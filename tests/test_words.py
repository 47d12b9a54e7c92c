"""Word statistics against Spark's own vocabulary models."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer, Tokenizer, VectorAssembler
from pyspark.sql import functions as F

import scrubwell as sw
from scrubwell.operators import words as module
from scrubwell.operators.features import fit_features


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    own = {"a": ["sun", "sea", "sand"], "b": ["snow", "ice", "sun"], "c": ["rain", "fog", ""]}
    rows = []
    for i in range(400):
        label = rng.choice("aabc")
        words = [rng.choice(own[label]) if rng.random() < 0.6 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 15))]
        rows.append((i, " ".join(words).title(), " ".join(rng.sample(words, 1)), float(rng.randrange(4)), label))
    rows += [(400, "", " ", 0.0, "a"), (401, "  two  blanks ", "\tTab\nLINE\n", 1.0, "b")] + [(402 + i, "same words same", "again", 2.0, "c") for i in range(30)]
    return spark.createDataFrame(rows, "id int, text string, more string, n double, label string")


@pytest.fixture(params=["broadcast", "shuffled", "both"])
def way(request, monkeypatch):
    monkeypatch.setattr(module, "HOT_BYTES", {"broadcast": 1 << 30, "shuffled": 0, "both": 2000}[request.param])
    return request.param


def reference(train):
    stages = [StringIndexer(inputCol="label", outputCol="y")]
    for c in ("text", "more"):
        stages += [Tokenizer(inputCol=c, outputCol=f"{c}_w"), CountVectorizer(inputCol=f"{c}_w", outputCol=f"{c}_tf"), IDF(inputCol=f"{c}_tf", outputCol=f"{c}_x")]
    stages += [VectorAssembler(inputCols=["text_x", "more_x", "n"], outputCol="features"), NaiveBayes(labelCol="y")]
    return Pipeline(stages=stages).fit(train)


def test_words_are_those_of_the_tokenizer(spark):
    odd = ["", " ", "\t\n", "a", " a", "a ", "a  b", "A\tB\nC\r\n", "x\x0by\x0cz ", "caf\u00c9 \u00a0x", None]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    wanted = Tokenizer(inputCol="t", outputCol="w").transform(df.filter("t IS NOT NULL")).collect()
    found = df.select("t", module.words(F.col("t")).alias("w")).collect()
    assert [(r["t"], r["w"]) for r in found if r["t"] is not None] == [(r["t"], r["w"]) for r in wanted]
    assert found[-1]["w"] is None


def test_naive_bayes_predicts_what_sparks_does(texts, way):
    train, test = texts.filter("id % 3 <> 0"), texts.filter("id % 3 = 0")
    model = reference(train)
    wanted = {r["id"]: r["prediction"] for r in model.transform(test).collect()}
    numbered = model.stages[0].transform(texts)
    own = module.fit_naive_bayes(numbered.filter("id % 3 <> 0"), ["text", "more", "n"], "y")
    assert own.statistics.n_features == model.stages[-1].numFeatures
    assert (own.statistics.hot_floor == 0) == (way == "broadcast")
    for row, (c, share, weight) in enumerate(own.classes):
        assert share == pytest.approx(model.stages[-1].pi[int(c)]) and c == row
    found = {r["id"]: r["prediction"] for r in own.predict(numbered.filter("id % 3 = 0"), "id", "y").collect()}
    assert found == wanted


def test_vectors_are_sparks_tf_idf(texts, way):
    model = reference(texts)
    wanted = {r["id"]: sorted(float(v) for v in r["features"].toArray() if v) for r in model.transform(texts).collect()}
    fitted = fit_features(texts.select("id", "text", "more", "n"), "id", "text_classification")
    found = fitted.transform(texts).collect()
    assert len(found) == texts.count() and fitted.slots == {"features": model.stages[-1].numFeatures}
    for r in found:
        slots = [f["slot"] for f in r["features"]]
        assert slots == sorted(set(slots)) and all(0 <= s < fitted.slots["features"] for s in slots)
        assert sorted(f["weight"] for f in r["features"] if f["weight"]) == pytest.approx(wanted[int(r["label"])])


def test_new_words_and_labels(spark, texts):
    learned = module.fit_naive_bayes(texts.filter("label <> 'c'").withColumn("y", (F.col("label") == "b").cast("double")), ["text"], "y")
    new = spark.createDataFrame([(1, "unheard of", 0.0), (2, None, 1.0), (3, "sea sea sea", 0.0)], "id int, text string, y double")
    assert {r["id"]: r["prediction"] for r in learned.predict(new, "id", "y").collect()} == {1: 0.0, 2: 0.0, 3: 0.0}
    assert learned.predict(new.limit(0), "id", "y").count() == 0


def test_unusable_columns(spark, texts):
    with pytest.raises(ValueError, match="'n'"):
        module.word_statistics(texts.withColumn("n", -F.col("n")), ["text", "n"])
    with pytest.raises(ValueError, match="list"):
        module.word_statistics(texts.withColumn("list", F.array("n")), ["list"])
    with pytest.raises(ValueError):
        module.word_statistics(texts, [])
    only_target = sw.evaluate(texts.select("label"), "label", "text_classification").first()
    assert only_target["status"] == "failed" and only_target["error"]


def test_words_whose_digests_collide(texts, monkeypatch):
    real = module.value_key
    monkeypatch.setattr(module, "value_key", lambda v, wide=False: real(v, True) if wide else F.substring(real(v), 1, 1))
    statistics = module.word_statistics(texts, ["text"])
    assert statistics.wide and statistics.table.select("__key").distinct().count() == statistics.n_features


def test_running_totals_deal_ranges_of_bounded_size(spark, monkeypatch):
    from scrubwell.functions import indexing

    monkeypatch.setattr(indexing, "SMALL_INDEX", 50)
    table = spark.range(400).select((F.col("id") * 7 % 400).alias("v"))
    placed = indexing.running_totals(table, [F.asc("v")], F.lit(1).cast("bigint"), False, 400)
    by_task = [r[1] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(by_task) >= 8 and max(by_task) <= 100
    assert {r["v"]: r["__before"] for r in placed.collect()} == {v: v for v in range(400)}
