"""Elastic nets from sums, chosen changepoints and regressors."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import elastic as el
from panelcast.operators import learned as ln
from panelcast.series import Series

SMALL = Series(chunk_rows=32)


def proximal(x, y, lasso, ridge, steps=60_000):
    """The same problem by plain proximal gradient steps on the rows themselves."""
    sd, sy = x.std(axis=0), y.std()
    z, t = (x - x.mean(axis=0)) / sd, (y - y.mean()) / sy
    n, b = len(t), np.zeros(x.shape[1])
    rate = 1 / (np.linalg.eigvalsh(z.T @ z / n).max() + np.max(ridge))
    for _ in range(steps):
        b = b - rate * (z.T @ (z @ b - t) / n + ridge * b)
        b = np.sign(b) * np.maximum(np.abs(b) - rate * lasso, 0)
    beta = b * sy / sd
    return np.r_[y.mean() - x.mean(axis=0) @ beta, beta]


@pytest.mark.parametrize("lasso,ridge", [(0.05, 0.0), (0.2, 0.1), (0.0, 0.3), (2.0, 0.0), ([0.3, 0.0, 0.1, 0.0, 0.05], [0.0, 0.2, 0.0, 0.0, 0.1])])
def test_net_equals_a_reference_solution(lasso, ridge):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 3
    y = x @ [2.0, 0.0, -1.0, 0.0, 0.3] + rng.normal(size=200)
    full = np.column_stack([np.ones(200), x])
    got = el.make_elastic_net()((full.T @ full).ravel(), full.T @ y, y @ y, 200.0, lasso, ridge)
    want = proximal(x, y, np.asarray(lasso, dtype=float), np.asarray(ridge, dtype=float))
    assert got == pytest.approx(want, abs=1e-8)
    assert ((got == 0) == (np.abs(want) < 1e-12)).all()


def test_columns_that_do_not_vary_and_empty_sums():
    net = el.make_elastic_net()
    x = np.column_stack([np.ones(6), np.full(6, 7.0), np.arange(6.0)])
    y = 2 + 3 * np.arange(6.0)
    assert net((x.T @ x).ravel(), x.T @ y, y @ y, 6.0, 0.0, 0.0) == pytest.approx([2, 0, 3])
    flat = np.full(6, 4.0)
    assert net((x.T @ x).ravel(), x.T @ flat, flat @ flat, 6.0, 0.1, 0.1) == pytest.approx([4, 0, 0])
    assert np.isnan(net([0.0], [0.0], 0.0, 0.0, 0.1, 0.1)).all()


def bent_panel(spark):
    """Two series whose growth changes once, at two fifths of 400 training weeks, plus a known regressor."""
    rng = np.random.default_rng(6)
    rows = []
    for uf, slope in (("A", 4.0), ("B", -3.0)):
        for i in range(460):
            date = dt.date(2010, 1, 3) + dt.timedelta(weeks=i)
            t, event = i / 399, float(rng.random() < 0.2)
            level = 5 + t + slope * max(t - 0.4, 0) + 0.8 * event + 0.3 * math.sin(2 * math.pi * date.toordinal() / 365.25)
            rows.append((uf, date, int(round(math.expm1(level))), event))
    return spark.createDataFrame(rows, "uf string, date date, casos bigint, event double")


CUT = str(dt.date(2010, 1, 3) + dt.timedelta(weeks=399))
OPTIONS = {"regressors": ["event"], "terms": [(365.25, 1)], "changepoints": 8, "s": SMALL}


def test_the_changepoint_is_chosen_and_the_regressor_learned(spark):
    rows = el.trend_coefficients(bent_panel(spark), CUT, lasso=0.01, **OPTIONS).collect()
    for uf, sign in (("A", 1), ("B", -1)):
        mine = {r.feature: r.coefficient for r in rows if r.uf == uf}
        bends = {k: v for k, v in mine.items() if k.startswith("changepoint_")}
        assert max(bends, key=lambda k: abs(bends[k])) in ("changepoint_3", "changepoint_4", "changepoint_5")
        assert sum(v != 0 for v in bends.values()) < 8
        assert sign * sum(bends.values()) > 0
        assert mine["event"] == pytest.approx(0.8, abs=0.1)


def test_regressors_help_and_nothing_after_the_cutoff_matters(spark):
    df = bent_panel(spark)
    later = F.col("date") > F.lit(CUT).cast("date")
    one = {(r.uf, r.date): r for r in el.trend_regression(df, CUT, **OPTIONS).collect()}
    plain = el.trend_regression(df, CUT, **{**OPTIONS, "regressors": []}).collect()
    assert len(one) == 2 * 60 == len(plain)
    miss = lambda rows: sum(abs(math.log1p(r["median"]) - math.log1p(r.casos)) for r in rows)
    assert miss(one.values()) < 0.7 * miss(plain)
    assert all(r.lower_95 <= r.lower_50 <= r.upper_50 <= r.upper_95 for r in one.values())
    changed = df.withColumn("casos", F.when(later, F.col("casos") * 10).otherwise(F.col("casos")))
    for r in el.trend_regression(changed, CUT, **OPTIONS).collect():
        assert r["median"] == pytest.approx(one[r.uf, r.date]["median"]) and r.upper_95 == pytest.approx(one[r.uf, r.date].upper_95)


def test_rows_without_a_regressor_get_no_forecast(spark):
    df = bent_panel(spark).withColumn("event", F.when(F.col("date") < "2018-06-01", F.col("event")))
    assert el.trend_regression(df, CUT, **OPTIONS).where("date >= '2018-06-01'").count() == 0


def test_search_scores_are_the_held_out_errors(spark):
    df = bent_panel(spark).withColumn("y", F.log1p(F.col("casos").cast("double"))).withColumn("t", F.datediff("date", F.lit("2010-01-03").cast("date")) / 700)
    rows = ln.lag_design(df, ["t", "event"])
    halves = [rows.where(F.col("t") < 3), rows.where(F.col("t") >= 3)]
    sums = [ln.moments(h, "y", ("uf",), SMALL) for h in halves]
    grid = [{"lasso": a, "ridge": b} for a in (0.0, 0.2) for b in (0.0, 0.1)]
    got = {(r.uf, r.trial): r.score for r in el.search_elastic_net(*sums, ("uf",), grid).collect()}
    assert len(got) == 8
    fit, held = ([r for r in h.collect() if r.uf == "A"] for h in halves)
    for i, g in enumerate(grid):
        beta = proximal(np.array([r._x[1:] for r in fit]), np.array([r.y for r in fit]), g["lasso"], g["ridge"], 5000)
        want = np.sqrt(np.mean([(r.y - beta @ np.array(r._x)) ** 2 for r in held]))
        assert got["A", i] == pytest.approx(want, rel=1e-6)


def test_expected_values_come_from_training_only(spark):
    rows = [("A", dt.date(2001, 1, 7) + dt.timedelta(weeks=i), 200101 + i % 4, float(i)) for i in range(12)] + [("A", dt.date(2002, 1, 6), 200209, 99.0)]
    got = el.expected_by_week(spark.createDataFrame(rows, "uf string, date date, epiweek int, x double"), ["x"], "2001-03-03").orderBy("date").collect()
    assert [r.x_expected for r in got] == [2.0, 3.0, 4.0, 5.0] * 3 + [3.5]
