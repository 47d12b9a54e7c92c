import pytest

import scrubwell as sw
from helpers import by, rows


@pytest.fixture(scope="module")
def raw(spark):
    data = [(i, float(i % 5) if i % 4 else None, "T%d www.x.y" % (i % 3), "yes" if i % 3 else "no") for i in range(60)]
    data += data[:3] + [(7, 100000.0, "far", "yes")]
    return spark.createDataFrame(data, "k int, v double, t string, y string")


def test_steps_in_order(raw):
    plan = (
        sw.CleaningPlan("y").index_target().handle_missing("median", mode="exact").drop_duplicates()
        .remove_outliers(mode="exact").clean_text(["t"]).materialize().resample("under")
    )
    step = sw.index_target(raw, "y")
    step = sw.handle_missing(step, "median", mode="exact")
    step = sw.drop_duplicates(step, "y")
    step = sw.remove_outliers(step, "y", mode="exact")
    step = sw.undersample(sw.clean_text_columns(step, ["t"]), "y")
    assert rows(plan.apply(raw)) == rows(step)
    assert [s.name for s in plan.steps] == [
        "index_target", "handle_missing", "drop_duplicates", "remove_outliers", "clean_text", "materialize", "resample",
    ]


def test_plans_are_values(raw):
    base = sw.CleaningPlan("y").drop_duplicates()
    longer = base.timestamp_features()
    assert len(base.steps) == 1 and len(longer.steps) == 2
    assert base == sw.CleaningPlan("y").drop_duplicates() and hash(base) == hash(sw.CleaningPlan("y").drop_duplicates())
    assert longer.reset().apply(raw) is raw
    split = base.resample("over", train_only=True)
    assert split.before_split() == base and [s.name for s in split.for_training().steps] == ["resample"]
    assert base.for_training() is None


def test_wrong_options_fail_when_the_plan_is_made():
    plan = sw.CleaningPlan("y")
    for bad in (lambda: plan.handle_missing("x"), lambda: plan.fix_skew("x"), lambda: plan.resample("x")):
        with pytest.raises(ValueError):
            bad()


def test_transforms_can_be_undone(raw):
    done = sw.CleaningPlan("v").fix_skew("log").fix_skew("sqrt", threshold=0.5).run(raw.select("v"))
    assert done.transforms == (("log", ("v",)), ("sqrt", ("v",)))
    undo = done.inverse_of("v")
    restored = done.table.select(undo(done.table["v"]).alias("v"))
    assert sorted(round(r["v"], 6) for r in restored.na.drop().collect()) == sorted(r["v"] for r in raw.select("v").na.drop().collect())
    assert done.inverse_of("k") is None


def test_report(raw):
    report = sw.issue_report(raw, "y", "classification", mode="exact")
    assert set(report) == {
        "schema", "missing", "missing_rows", "duplicates", "skewness", "high_skew", "outliers", "box", "correlation",
        "classes", "imbalance",
    }
    assert rows(report["missing"]) == rows(sw.missing_counts(raw))
    assert rows(report["skewness"]) == rows(sw.skewness_report(raw, "y"))
    assert rows(report["outliers"]) == rows(sw.outlier_report(raw, "y", mode="exact"))
    assert rows(report["box"]) == rows(sw.box_stats(raw, mode="exact"))
    assert rows(report["high_skew"]) == rows(sw.high_skew_columns(raw))
    assert rows(report["duplicates"]) == rows(sw.duplicate_groups(raw, "y"))
    assert "classes" not in sw.issue_report(raw, "v", "regression")
    with pytest.raises(ValueError, match="unknown task"):
        sw.issue_report(raw, "y", "ranking")


def test_report_on_one_type_and_no_rows(spark, raw):
    for part in (raw.select("y"), raw.select("k"), raw.limit(0)):
        target = part.columns[-1]
        report = sw.issue_report(part, target, "classification")
        for frame in report.values():
            frame.collect()


def test_profile(nulls):
    exact = by(sw.column_profile(nulls, mode="exact"))
    assert exact["i"]["n_distinct"] == 3 and exact["i"]["n_missing"] == 1 and exact["i"]["q50"] == 2.0
    assert exact["s"]["n_missing"] == 2 and exact["s"]["n_distinct"] == 2 and exact["s"]["max_text"] == "a"
    assert exact["none"]["n_distinct"] == 0 and exact["none"]["mean"] is None
    assert exact["d"]["max"] == 4.0
    approx = by(sw.column_profile(nulls))
    assert {c: r["n_distinct"] for c, r in approx.items() if c != "d"} == {c: r["n_distinct"] for c, r in exact.items() if c != "d"}
    top = [tuple(r) for r in sw.top_values(nulls.select("s"), 2).orderBy("rank").collect()]
    assert top == [("s", 1, "a", 2), ("s", 2, "", 1)]
