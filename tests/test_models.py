import math
import random

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

import scrubwell as sw
from helpers import by, rows
from scrubwell.operators import features as features_module
from scrubwell.operators.evaluate import evaluate


@pytest.fixture(scope="module")
def learnable(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        kind, x = f"k{i % 40}", rng.random() * 10
        label = "hi" if x > 5 else "lo"
        words = " ".join(rng.choice(["sun", "sea", "sand"] if x > 5 else ["snow", "ice", "fog"]) for _ in range(6))
        data.append((x, -x, kind, words, 3 * x + 2 + rng.random() * 0.1, label))
    return spark.createDataFrame(data, "x double, minus double, kind string, words string, y double, label string")


def test_prepare(nulls):
    ready = sw.prepare_rows(nulls, "y", "classification")
    assert ready.count() == 3 and "ts" not in ready.columns and {"ts_year", "tn_day", "dt_month"} <= set(ready.columns)
    third = ready.filter("one = 7 AND i = -1").first()
    assert third["s"] == "missing" and third["d"] == -1.0 and third["b"] == -1
    zero = sw.prepare_rows(nulls, "y", "text_classification")
    assert zero.filter("i = 0").count() == 1
    with pytest.raises(ValueError):
        sw.prepare_rows(nulls, "y", "ranking")


def test_max_bins(learnable, spark):
    assert rows(sw.max_bins(learnable.select("kind", "y"), "y")) == [(80,)]
    assert rows(sw.max_bins(learnable.select("kind", "label", "y"), "kind")) == [(64,)]
    assert rows(sw.max_bins(spark.range(3), "id")) == [(64,)]


def test_metrics_agree_with_the_evaluators(spark):
    rng = random.Random(1)
    df = spark.createDataFrame(
        [(float(rng.randrange(4)), float(rng.randrange(3)) + (2.0 if rng.random() < 0.1 else 0.0)) for _ in range(300)],
        "label double, prediction double",
    )
    got = sw.classification_metrics(df).first()
    for name, metric in (("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        want = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
        assert got[name] == pytest.approx(100 * want, abs=0.006)
    got = sw.regression_metrics(df).first()
    assert got["rmse"] == pytest.approx(RegressionEvaluator(metricName="rmse").evaluate(df), abs=0.0006)
    assert got["mse"] == pytest.approx(RegressionEvaluator(metricName="mse").evaluate(df), abs=0.0006)


def test_regression_learns(learnable):
    result = by(sw.evaluate(learnable.drop("label", "words"), "y", "regression"), "model")
    assert list(result) == ["Linear Regression", "Decision Tree", "Random Forest"]
    assert all(r["status"] == "ok" for r in result.values())  # 40 categories need more than 32 bins
    assert result["Linear Regression"]["rmse"] < 0.1
    assert max(r["rmse"] for r in result.values()) < 8.6  # the constant predictor


def test_classification_learns(learnable):
    result = by(sw.evaluate(learnable.drop("y", "x", "minus"), "label", "classification"), "model")
    assert list(result) == ["Logistic Regression", "Decision Tree", "Random Forest"]
    assert all(r["status"] == "ok" for r in result.values())
    # a forest looks at 512 of 262,144 hashed slots per node and rarely meets the six words used here
    assert result["Logistic Regression"]["accuracy"] > 95 and result["Decision Tree"]["accuracy"] > 80


def test_text_learns_and_fails_visibly(learnable):
    good = sw.evaluate(learnable.select("words", "label"), "label", "text_classification").collect()
    assert good[0]["model"] == "Naive Bayes" and good[0]["accuracy"] == 100.0
    bad = sw.evaluate(learnable.select("words", "minus", "label"), "label", "text_classification").collect()
    assert bad[0]["status"] == "failed" and bad[0]["accuracy"] is None and bad[0]["error"]


def test_feature_kinds_and_slots(learnable):
    fitted = features_module.fit_features(learnable.drop("y"), "label", "classification")
    assert fitted.kinds == {"x": "number", "minus": "number", "kind": "category", "words": "text"}
    assert fitted.max_bins == 80
    out = fitted.transform(learnable)
    meta = out.schema["features"].metadata["ml_attr"]
    assert meta["num_attrs"] == out.first()["features"].size == 3 + 262144
    assert meta["attrs"]["nominal"] == [{"type": "nominal", "idx": 2, "num_vals": 40}]
    assert "attrs" not in out.schema["tree_features"].metadata["ml_attr"]  # two classes put categories in order


def cells(df, *columns):
    from pyspark.ml.functions import vector_to_array

    return df.select(*[vector_to_array(c).alias(c) for c in columns], "label").collect()


def test_trees_read_categories_in_bins_however_many(spark):
    rows = spark.range(12_000).selectExpr("concat('v', id) AS kind", "id * 0.5 AS y")
    fitted = features_module.fit_features(rows, "y", "regression")
    assert fitted.kinds == {"kind": "category"} and fitted.max_bins == 128 and fitted.tree_column == "tree_features"
    found = {r["label"]: r["tree_features"][0] for r in cells(fitted.transform(rows), "tree_features")}
    assert all(b == (2 * place + 1) * 64 // 24_000 for place, (_, b) in enumerate(sorted(found.items())))
    new = fitted.transform(spark.sql("SELECT 'new' AS kind, 1.0D AS y")).first()
    assert new["features"] is None and new["tree_features"][0] == 31.5  # where the mean of all rows lies


def test_categories_of_several_classes_stay_categories(spark):
    rows = spark.range(900).selectExpr("concat('k', id % 7) AS kind", "concat('c', id % 7 % 3) AS y")
    fitted = features_module.fit_features(rows, "y", "classification", [])
    out = fitted.transform(rows.unionByName(spark.sql("SELECT 'new' AS kind, 'c1' AS y")))
    assert out.schema["tree_features"].metadata["ml_attr"]["attrs"]["nominal"] == [{"type": "nominal", "idx": 0, "num_vals": 8}]
    assert {r["tree_features"][0] for r in cells(out.filter("features IS NULL"), "tree_features")} == {7.0}
    noisy = rows.withColumn("noise", F.monotonically_increasing_id() % 90)  # equal rows are on one side of the split
    result = sw.evaluate(noisy, "y", "classification", only=["Decision Tree"]).first()
    assert result["accuracy"] == 100.0 and result["n_features"] == 2


def test_more_than_a_hundred_classes(spark):
    rows = spark.range(3000).selectExpr("id AS x", "concat('c', id % 150) AS y")
    found = sw.evaluate(rows, "y", "classification", only=["Decision Tree"]).first()
    assert found["status"] == "ok" and found["n_scored"] == found["n_test"]


def test_forest_does_not_depend_on_partitions(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_custkey", "o_orderstatus", "o_totalprice")
    few, many = (sw.evaluate(orders.repartition(n), "o_totalprice", "regression", only=["Random Forest"]).first() for n in (3, 9))
    assert few == many and few["status"] == "ok"


def test_values_without_training_rows(spark):
    rows = spark.range(300).selectExpr("concat('v', id) AS kind", "id * 0.5 AS y")
    found = by(sw.evaluate(rows, "y", "regression"), "model")
    linear, tree = found["Linear Regression"], found["Decision Tree"]
    assert (linear["status"], linear["n_scored"], linear["rmse"]) == ("failed", 0, None)
    assert (tree["status"], tree["n_scored"]) == ("ok", tree["n_test"]) and tree["rmse"] < 90
    assert linear["n_train"] + linear["n_test"] == 300


def test_errors_of_the_cluster_are_raised():
    from scrubwell.operators import evaluate as module

    assert module._reason(ValueError("too few bins\nmore")) == "too few bins"
    with pytest.raises(RuntimeError):
        module._reason(RuntimeError("Job aborted: ExecutorLostFailure (executor 3)"))


def test_awkward_feature_names(spark):
    df = spark.createDataFrame(
        [(float(i), "a" if i % 2 else "b", float(i % 2), float(i)) for i in range(200)],
        "`a.b` double, `x` string, `x_idx` double, `my y` double",
    )
    assert all(r["status"] == "ok" for r in sw.evaluate(df, "my y", "regression").collect())


def test_unusable_tables_give_failed_rows(spark):
    df = spark.createDataFrame([(1.0, [1.0, 2.0])] * 20, "y double, nested array<double>")
    result = sw.evaluate(df, "y", "regression").collect()
    assert len(result) == 3 and all(r["status"] == "failed" and r["error"] for r in result)


def test_compare_versions(learnable):
    raw = learnable.select("x", "y")
    result = sw.compare(raw, sw.drop_duplicates(raw), "y", "regression").collect()
    assert [r["version"] for r in result] == ["raw"] * 3 + ["cleaned"] * 3
    for before, after in zip(result[:3], result[3:]):
        assert after["rmse_change"] == pytest.approx(after["rmse"] - before["rmse"], abs=0.001)
        assert before["rmse_change"] is None
    with pytest.raises(ValueError, match="needs the plan"):
        sw.compare(raw, raw, "y", "regression", original_scale=True)


def test_original_scale(spark):
    df = spark.createDataFrame([(i / 40, math.exp(i / 40)) for i in range(400)], "x double, y double")
    plan = sw.CleaningPlan("y").fix_skew("log")
    on_log = by(sw.compare(df, plan, "y", "regression").filter("version = 'cleaned'"), "model")
    on_unit = by(sw.compare(df, plan, "y", "regression", original_scale=True).filter("version = 'cleaned'"), "model")
    assert on_log["Decision Tree"]["rmse"] < 1 < on_unit["Decision Tree"]["rmse"]


def test_training_steps_do_not_reach_the_test_rows(learnable, monkeypatch):
    seen = {}
    from scrubwell.operators import evaluate as module

    original = module.fit_naive_bayes

    def spy(train, *rest):
        seen["sizes"] = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
        return original(train, *rest)

    monkeypatch.setattr(module, "fit_naive_bayes", spy)
    rare = learnable.select("words", "label").filter("label = 'hi' OR hash(words) % 5 = 0")
    plan = sw.CleaningPlan("label").resample("over", train_only=True)
    evaluate(rare, "label", "text_classification", train_steps=plan)
    assert len(set(seen["sizes"].values())) == 1


def test_trees_read_words_in_few_slots(spark):
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = ["alpha beta alpha gamma delta", "epsilon zeta eta theta iota"]
    rows = spark.createDataFrame([(t, float(i)) for i, t in enumerate(words)], "text string, y double")
    fitted = features_module.fit_features(rows, "y", "classification", ["text"])
    found = fitted.transform(rows).select("label", vector_to_array("tree_features").alias("t"), vector_to_array("features").alias("f")).collect()
    assert fitted.tree_column == "tree_features"
    for r in found:
        for column, width in (("t", features_module.TREE_SLOTS), ("f", 262144)):
            wanted = [0.0] * width
            for w in words[int(r["label"])].split():
                wanted[HashingTF(numFeatures=width).indexOf(w)] += 1
            assert r[column] == wanted


def test_rows_are_dealt_by_bytes_of_strings_too(spark, monkeypatch):
    """Long texts take more partitions, so that no task reads more than its share of bytes; few short rows take 8."""
    from scrubwell.operators import evaluate

    texts = spark.range(20).selectExpr("repeat('w ', 500) AS text", "id % 2 AS quality")
    assert evaluate._partitions(texts, ["text"]) == evaluate.PARTITIONS
    monkeypatch.setattr(evaluate, "PARTITION_BYTES", 1000)
    assert evaluate._partitions(texts, ["text"]) == 20
    assert evaluate._partitions(texts.selectExpr("CAST(NULL AS string) AS text", "quality"), ["text"]) == evaluate.PARTITIONS
