import math

import pytest
from pyspark.sql import functions as F

from panelcast.operators import scores as m


def one(spark, rows, schema, expr):
    return spark.createDataFrame(rows, schema).agg(expr.alias("v")).first().v


def points(spark, y, p, score):
    return one(spark, [(float(a), float(b)) for a, b in zip(y, p)], "y double, p double", score(F.col("y"), F.col("p")))


def test_point_scores(spark):
    assert points(spark, [0, 4, 3], [3, 1, 3], m.rmse) == pytest.approx(math.sqrt(6))
    assert points(spark, [5, 5, 5], [3, 7, 5], m.mae) == pytest.approx(4 / 3)
    assert points(spark, [100] * 3, [90, 110, 100], m.mape) == pytest.approx(20 / 3, abs=0.01)
    assert points(spark, [5] * 3, [6] * 3, m.bias) == 1
    assert points(spark, [5] * 3, [4] * 3, m.bias) == -1
    assert points(spark, [0], [0], m.mape) == 0
    assert points(spark, [1e12], [1e12], m.rmse) == 0


def test_no_rows_score_null(spark):
    empty = spark.createDataFrame([], "y double, p double")
    assert empty.agg(m.rmse(F.col("y"), F.col("p")).alias("v")).first().v is None


@pytest.mark.parametrize("y,want", [(0, 1.25), (5, 2 / 3), (10, 89 / 12)])
def test_crps_of_one_row(spark, y, want):
    q = [(0.25, F.lit(3.0)), (0.5, F.lit(5.0)), (0.75, F.lit(7.0))]
    got = spark.range(1).select(m.crps_row(F.lit(float(y)), q).alias("v")).first().v
    assert got == pytest.approx(want, abs=1e-6)


def test_crps_may_be_negative_but_pinball_is_not(spark):
    q = [(0.25, F.lit(300.0)), (0.5, F.lit(500.0)), (0.75, F.lit(700.0))]
    row = spark.range(1).select(m.crps_row(F.lit(0.0), q).alias("a"), m.pinball_row(F.lit(0.0), q).alias("b")).first()
    assert row.a == pytest.approx(-30400) and row.b > 0


def intervals(spark, rows):
    return spark.createDataFrame(rows, "casos double, median double, lower_50 double, upper_50 double")


def test_coverage_counts_bounds_as_inside(spark):
    part = intervals(spark, [(5.0, 5.0, 4.0, 6.0), (10.0, 5.0, 4.0, 6.0), (15.0, 5.0, 4.0, 6.0)])
    assert m.evaluate(part, []).first().coverage_50 == pytest.approx(1 / 3)
    edge = intervals(spark, [(5.0, 7.0, 5.0, 10.0), (10.0, 7.0, 5.0, 10.0)])
    assert m.evaluate(edge, []).first().coverage_50 == 1


def test_width_and_sharpness(spark):
    df = intervals(spark, [(1.0, 5.0, 4.0, 6.0), (1.0, 7.0, 5.0, 10.0)])
    assert m.evaluate(df, []).first().width_50 == 3.5
    assert m.sharpness(df, [], 50).first().sharpness == 3.5
    assert m.sharpness(intervals(spark, [(10.0, 5.0, 4.0, 6.0)]), [], 50).first().relative_sharpness == pytest.approx(0.2)


def test_rows_without_median_are_skipped_and_missing_levels_left_out(spark):
    df = intervals(spark, [(5.0, 5.0, 4.0, 6.0), (7.0, None, 4.0, 6.0), (15.0, 15.0, 14.0, 16.0)])
    got = m.evaluate(df, []).first().asDict()
    assert got["rmse"] == 0 and "coverage_50" in got and "coverage_95" not in got


def test_median_only_has_no_interval_score(spark):
    df = spark.createDataFrame([(5.0, 4.0)], "casos double, median double")
    got = m.evaluate(df, []).first()
    assert got.wis_total is None and got.rmse == 1 and got.crps is not None


def test_equal_forecasts_have_no_skill(spark):
    rows = [("A", i, k, 5.0, 4.0) for i in range(3) for k in ("base", "model")]
    df = spark.createDataFrame(rows, "uf string, date int, model string, casos double, median double")
    assert m.skill_score(df, "base").first().skill == 0
    with pytest.raises(ValueError):
        m.skill_score(df, "base", "r2")


def test_weights_must_match_levels(spark):
    df = intervals(spark, [(5.0, 5.0, 4.0, 6.0)])
    with pytest.raises(ValueError):
        m.wis_total_row(df, F.col("casos"), [50, 80], [1.0])


def test_coverage_is_a_share(spark, panel):
    from panelcast.operators.forecasts import baseline_forecasts

    got = m.evaluate(baseline_forecasts(panel), ["uf", "model"], levels=m.ALL_LEVELS).collect()
    assert got
    for row in got:
        for n in m.ALL_LEVELS:
            assert 0 <= row[f"coverage_{n}"] <= 1
        assert row.crps_pinball >= 0
