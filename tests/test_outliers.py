import pytest

import scrubwell as sw
from helpers import by, rows


@pytest.fixture(scope="module")
def far(spark):
    data = [(float(i), i, "k%d" % (i % 3), 1) for i in range(1, 101)]
    data += [(10_000.0, 50, "rare", 1), (-10_000.0, 50, None, 1), (None, 50, "k0", 1), (50.0, 1_000_000, "k1", 1)]
    return spark.createDataFrame(data, "v double, w int, s string, y int")


def test_bounds_and_counts(far):
    found = by(sw.outlier_report(far, "y", mode="exact"))
    assert found["v"]["outlier_count"] == 2
    assert found["w"]["outlier_count"] == 1
    q1, q3 = found["v"]["q1"], found["v"]["q3"]
    assert found["v"]["lower_bound"] == pytest.approx(q1 - 5 * (q3 - q1), abs=0.05)
    assert found["s"]["outlier_count"] == 2  # "rare" and NULL
    assert "y" not in found
    assert [r["outlier_count"] for r in sw.outlier_report(far, "y", mode="exact").collect()] == [2, 2, 1]


def test_approximate_bounds_are_close(far):
    found = by(sw.numeric_outliers(far, "y"))
    assert abs(found["v"]["q1"] - 26) <= 6 and found["v"]["outlier_count"] == 2


def test_values_on_the_bound_stay(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 1, 2, 2, 3, 3]], "v double")
    q1, q3 = 0.75, 2.25
    edge = spark.createDataFrame([(q1 - 5 * (q3 - q1),), (q3 + 5 * (q3 - q1),)], "v double")
    both = df.unionByName(edge)
    bounds = by(sw.numeric_outliers(both, mode="exact"))["v"]
    kept = sw.remove_outliers(both, mode="exact").count()
    assert kept == both.filter(f"v BETWEEN {bounds['lower_bound']} AND {bounds['upper_bound']}").count()


def test_remove_joint_and_sequential(far):
    joint = sw.remove_outliers(far, "y", mode="exact")
    assert joint.count() == 100  # two far values, one NULL and one far w go
    assert sw.remove_outliers(far, "y", mode="exact", keep_nulls=True).count() == 101
    assert sw.remove_outliers(far, "y", mode="exact", order="sequential").count() == 100
    assert sw.remove_outliers(far, "w", mode="exact").count() == 101
    with pytest.raises(ValueError, match="order is"):
        sw.remove_outliers(far, order="random")


def test_sequential_uses_what_is_left(spark):
    # The far v go first; the w that are left have equal quartiles, so 9 is outside. Among all w it is inside.
    data = [(1.0, 5.0)] * 16 + [(1.0, 9.0)] + [(1000.0 * (-1) ** i, 0.4 * i) for i in range(10)]
    df = spark.createDataFrame(data, "v double, w double")
    assert sw.remove_outliers(df, mode="exact", order="sequential").count() == 16
    assert sw.remove_outliers(df, mode="exact").count() == 17


def test_columns_without_values_are_skipped(nulls):
    assert "none" not in by(sw.numeric_outliers(nulls, mode="exact"))
    assert sw.remove_outliers(nulls.select("none", "one"), mode="exact").count() == 4
    assert rows(sw.numeric_outliers(nulls.select("none"))) == []


def test_box(far):
    box = by(sw.box_stats(far, mode="exact"))
    assert set(box) == {"v", "w", "y"}
    assert box["v"]["n"] == 103 and box["v"]["n_fliers"] == 2
    assert (box["v"]["whisker_low"], box["v"]["whisker_high"]) == (1.0, 100.0)
    assert (box["v"]["min"], box["v"]["max"]) == (-10_000.0, 10_000.0)
