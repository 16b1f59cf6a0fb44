import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import ensemble as e
from panelcast.operators import learned as ln
from panelcast.operators.forecasts import baseline_forecasts, cv_folds, sequence_windows, time_split
from panelcast.operators.prep import impute
from panelcast.operators.scores import LEVELS
from panelcast.operators.spline import make_natural_spline, spline_columns
from panelcast.series import Series

SMALL = Series(chunk_rows=32)


@pytest.fixture(scope="module")
def forecasts(panel):
    return baseline_forecasts(panel, s=SMALL).cache()


def test_weights_sum_to_one(forecasts):
    for metric in ("rmse", "mae", "crps_pinball"):
        for row in e.fit_weights(forecasts, metric).groupBy("uf").agg(F.sum("weight").alias("w")).collect():
            assert row.w == pytest.approx(1)
    moved = e.set_weights(e.fit_weights(forecasts), {"naive": 3.0, "nobody": 1.0})
    for row in moved.groupBy("uf").agg(F.sum("weight").alias("w")).collect():
        assert row.w == pytest.approx(1)


def test_negative_scores_get_no_weight(spark):
    rows = [("A", i, k, 0.0, *[100.0 * f for f in (1, 2, 3, 4, 5)]) for i in range(2) for k, f in (("m", 1),)]
    schema = "uf string, date int, model string, casos double, lower_95 double, lower_50 double, median double, upper_50 double, upper_95 double"
    row = e.fit_weights(spark.createDataFrame(rows, schema), "crps").first()
    assert row.score < 0 and row.weight is None


def test_calibrated_intervals_contain_the_given_ones(forecasts):
    one = forecasts.where(F.col("model") == "mean12")
    wide = e.apply_calibration(one, e.calibrate(one))
    pairs = wide.alias("w").join(one.alias("o"), ["uf", "date"])
    for n in LEVELS:
        assert pairs.where((F.col(f"w.lower_{n}") > F.col(f"o.lower_{n}")) | (F.col(f"w.upper_{n}") < F.col(f"o.upper_{n}"))).count() == 0


def test_calibration_matches_numpy(forecasts):
    one = forecasts.where(F.col("model") == "naive")
    got = {r.uf: r for r in e.calibrate(one).collect()}
    pdf = one.toPandas()
    for uf, g in pdf.groupby("uf"):
        for n in LEVELS:
            r = np.abs(np.concatenate([g[f"lower_{n}"] - g.casos, g.casos - g[f"upper_{n}"]]))
            q = min(np.ceil((len(r) + 1) * n / 100) / len(r), 0.999)
            assert got[uf][f"correction_{n}"] == pytest.approx(np.quantile(r, q))


def test_folds_and_split(panel):
    rows = panel.where("uf = 'A'")
    n = rows.count()
    size = n // 6
    parts = {(r.fold, r.role): r.n for r in cv_folds(rows, 5, 4, SMALL).groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    for i in range(5):
        assert parts[(i, "test")] == size and parts[(i, "train")] == n - (5 - i) * size - 4
    split = {r.split: r.n for r in time_split(rows, 0.2, SMALL).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split["train"] == math.floor(n * 0.8)


def test_sequences_need_a_full_past(panel):
    got = sequence_windows(panel, ["casos"], length=20, s=SMALL)
    counts = {r.uf: r.n for r in got.groupBy("uf").agg(F.count("*").alias("n")).collect()}
    total = {r.uf: r.n for r in panel.groupBy("uf").agg(F.count("*").alias("n")).collect()}
    assert counts == {k: v - 20 for k, v in total.items() if v > 20}


def test_spline_passes_through_known_points_and_reproduces_lines():
    spline = make_natural_spline()
    x = np.arange(6.0)
    assert spline(x, 2 * x + 1, 2.5) == pytest.approx(6)
    y = np.sin(x)
    assert spline(x, y, 3.0) == pytest.approx(y[3])


def test_spline_imputation_leaves_no_holes(panel):
    out = impute(panel, "spline", ["x"], SMALL)
    assert out.where(F.col("x").isNull()).count() == 0
    kept = out.join(panel.where(F.col("x").isNotNull()).select("uf", "date", F.col("x").alias("o")), ["uf", "date"])
    assert kept.where(F.abs(F.col("x") - F.col("o")) > 1e-12).count() == 0


@pytest.mark.parametrize("knots", [1, 2, 7, 1000])
def test_splines_in_blocks_are_those_of_whole_series(spark, knots):
    rnd = random.Random(9)
    rows, want = [], {}
    spline = make_natural_spline()
    for uf, n in (("A", 150), ("B", 40), ("C", 3), ("D", 1)):
        # knots close together and far apart
        x = [float(rnd.randint(-50, 50)) if i in (0, n - 1) or rnd.random() < (0.9 if i % 60 < 20 else 0.12) else None for i in range(n)]
        at = np.array([i for i in range(n) if x[i] is not None], dtype=float)
        y = np.array([v for v in x if v is not None])
        for i in range(n):
            rows.append((uf, dt.date(2000, 1, 2) + dt.timedelta(weeks=i), x[i]))
            want[uf, rows[-1][1]] = spline(at, y, float(i)) if x[i] is None else x[i]
    rows += [("E", dt.date(2000, 1, 2) + dt.timedelta(weeks=i), None) for i in range(4)]
    got = spline_columns(spark.createDataFrame(rows, "uf string, date date, x double"), ["x"], SMALL, knots).collect()
    assert len(got) == len(rows)
    assert all(r.x is None for r in got if r.uf == "E")
    for r in got:
        if r.uf != "E":
            assert r.x == pytest.approx(want[r.uf, r.date], rel=1e-9, abs=1e-9)


def seasonal_panel(spark):
    rows = []
    for k, uf in enumerate(("A", "B")):
        for i in range(520):
            date = dt.date(2010, 1, 3) + dt.timedelta(weeks=i)
            level = 3 + k + math.sin(2 * math.pi * date.toordinal() / 365.25)
            rows.append((uf, date, int(round(math.expm1(level)))))
    return spark.createDataFrame(rows, "uf string, date date, casos bigint")


def test_seasonal_regression_recovers_a_season(spark):
    df = seasonal_panel(spark)
    out = ln.seasonal_regression(df, "2018-06-24", penalty=1e-8, s=SMALL, terms=[(365.25, 2)], changepoints=2)
    worst = out.agg(F.max(F.abs(F.col("median") - F.col("casos")) / F.col("casos")).alias("w"), F.count("*").alias("n")).first()
    assert worst.n > 100 and worst.w < 0.1
    assert out.where((F.col("lower_95") > F.col("lower_50")) | (F.col("upper_50") > F.col("upper_95"))).count() == 0


def test_moments_give_the_least_squares_fit(spark):
    rnd = random.Random(2)
    rows = [("A", dt.date(2000, 1, 2) + dt.timedelta(weeks=i), rnd.random(), rnd.random(), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "uf string, date date, a double, b double, y double")
    beta = ln.fit_linear(ln.moments(ln.lag_design(df, ["a", "b"]), "y", ("uf",), SMALL), ("uf",), 0.0).first().beta
    x = np.array([[1, r[2], r[3]] for r in rows])
    want = np.linalg.lstsq(x, np.array([r[4] for r in rows]), rcond=None)[0]
    assert beta == pytest.approx(list(want))


def test_grid_search_scores_are_the_held_out_errors(spark):
    df = seasonal_panel(spark)
    trials = ln.tune_seasonal(df, [{"penalty": 1e-6}], s=SMALL, terms=[(365.25, 1)], changepoints=1).collect()
    rows = ln.seasonal_design(df, SMALL, [(365.25, 1)], 1).orderBy("uf", "date").collect()
    for t in trials:
        x = np.array([r._x for r in rows if r.uf == t.uf])
        y = np.log1p([r.casos for r in rows if r.uf == t.uf])
        cut = math.floor(len(y) * 0.8)
        beta = ln.make_ridge()(x[:cut].T @ x[:cut], x[:cut].T @ y[:cut], cut, 1e-6)
        assert t.score == pytest.approx(np.sqrt(np.mean((y[cut:] - x[cut:] @ beta) ** 2)), rel=1e-4)


def test_boosted_trees_forecast_every_later_row(spark):
    from panelcast.operators.features import lag_features

    df = lag_features(seasonal_panel(spark), lags=[1, 2, 52])
    out = ln.boosted_trees(df, ["casos_lag_1", "casos_lag_2", "casos_lag_52"], "2018-06-24", maxIter=3, maxDepth=3)
    later = df.where(F.col("date") > "2018-06-24").count()
    row = out.agg(F.count("median").alias("n"), F.max(F.abs(F.col("median") - F.col("casos"))).alias("miss"), F.max("casos").alias("top")).first()
    assert row.n == later and row.miss < row.top
    assert out.where((F.col("lower_95") > F.col("lower_50")) | (F.col("upper_50") > F.col("upper_95"))).count() == 0


def test_recursion_matches_a_loop(spark, panel):
    lags, beta = [1, 3], [0.5, 0.6, 0.2]
    coefficients = panel.select("uf").distinct().withColumn("beta", F.array(*[F.lit(b) for b in beta]))
    got = {(r.uf, r.step): r["median"] for r in ln.recursive_forecast(panel, coefficients, lags, 6).collect()}
    pdf = panel.toPandas().sort_values("date")
    for uf, g in pdf.groupby("uf"):
        past = [float(v) for v in g.casos]
        if len(past) < 3:
            continue
        for step in range(1, 7):
            past.append(beta[0] + beta[1] * past[-1] + beta[2] * past[-3])
            assert got[(uf, step)] == pytest.approx(past[-1])


def test_trees_forecast_rows_whose_target_is_unknown(spark):
    import datetime as dt
    import random

    from panelcast.operators.features import forecast_features, lag_features, diff_features
    from panelcast.operators.learned import boosted_trees

    rnd = random.Random(4)
    rows = [(u, dt.date(2001, 1, 7) + dt.timedelta(weeks=i), rnd.randint(0, 9) if i < 80 else None) for u in ("A", "B") for i in range(90)]
    df = spark.createDataFrame(rows, "uf string, date date, casos bigint")
    made = diff_features(lag_features(df, lags=[1, 2]), periods=[1])
    names = forecast_features(made)
    assert names == ["casos_lag_1", "casos_lag_2"]
    got = boosted_trees(made, names, "2002-07-14", maxIter=2, maxDepth=2)
    assert got.count() == 20 and got.where("median is null").count() == 0
