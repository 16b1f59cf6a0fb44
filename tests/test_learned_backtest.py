import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosting as b
from panelcast.operators import learned as ln
from panelcast.operators.forecasts import time_split
from panelcast.operators.scores import QUANTILE_COLUMNS
from panelcast.plans import learned_backtest as lb
from panelcast.plans import tuning
from panelcast.series import Series

SMALL = Series(chunk_rows=64)
START = dt.date(2001, 1, 7)
SEASONS = [("1", "a", "2003-06-29", "2003-10-05", "2004-06-27"), ("2", "b", "2004-06-27", "2004-10-03", "2005-06-26")]
MODELS = {"trees": {"rounds": 3, "depth": 2, "least": 5}, "regression": {"terms": [(365.25, 2)], "changepoints": 1}}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    out = []
    for k, uf in enumerate(("A", "B", "C")):
        for i in range(240):
            if rnd.random() < 0.1:
                continue
            date = START + dt.timedelta(weeks=i)
            level = 2 + k + math.sin(2 * math.pi * date.toordinal() / 365.25)
            out.append((uf, date, int(math.expm1(level) + rnd.randint(0, 4))))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "uf string, date date, casos bigint").repartition(3)


def test_nothing_after_a_cutoff_is_known(spark, rows):
    """Values after a test's cutoff change no forecast of any model for it."""
    made = {r[:4]: tuple(r[4:]) for r in lb.learned_forecasts(table(spark, rows), SEASONS, s=SMALL, **MODELS).collect()}
    assert {k[2] for k in made} == {"naive", "seasonal", "mean12", "seasonal_regression", "quantile_trees"}
    for test, _, end, _, _ in SEASONS:
        cutoff = dt.date.fromisoformat(end)
        changed = [(u, d, c * 10 + 7 if d > cutoff else c) for u, d, c in rows] + [("A", dt.date(2006, 1, 1), 999)]
        got = {r[:4]: tuple(r[4:]) for r in lb.learned_forecasts(table(spark, changed), SEASONS, s=SMALL, **MODELS).collect()}
        own = [k for k in made if k[1] == test]
        assert own and {k for k in got if k[1] == test} == set(own)
        for k in own:
            assert got[k] == pytest.approx(made[k], abs=1e-6), k


def test_quantiles_are_in_order_and_all_weeks_are_there(spark, rows):
    got = lb.tree_forecasts(table(spark, rows), SEASONS, s=SMALL, **MODELS["trees"]).collect()
    assert len(got) == 3 * sum((dt.date.fromisoformat(z) - dt.date.fromisoformat(a)).days // 7 + 1 for _, _, _, a, z in SEASONS)
    names = sorted(QUANTILE_COLUMNS, key=QUANTILE_COLUMNS.get)
    for r in got:
        values = [r[c] for c in names]
        assert values == sorted(values) and values[0] >= 0


def test_direct_rows_by_hand(spark, rows):
    made = lb.direct_rows(table(spark, rows), SEASONS, s=SMALL).collect()
    by = {}
    for u, d, c in rows:
        by.setdefault(u, []).append((d, math.log1p(c)))
    for r in random.Random(3).sample(made, 60):
        past = [y for d, y in by[r.uf] if d <= r.origin]
        assert (r.origin - [d for d, _ in by[r.uf] if d <= r.origin][-1]).days < lb.STEP
        assert r.base == pytest.approx(np.mean(past[-52:])) and r.level == r.base
        assert (r.recent, r.mean_4, r.mean_12) == pytest.approx((past[-1] - r.base, np.mean(past[-4:]) - r.base, np.mean(past[-12:]) - r.base))
        assert (r.date - r.origin).days == r.horizon
        like = r.date - dt.timedelta(days=lb.SEASON)
        while like > r.origin:
            like -= dt.timedelta(days=lb.SEASON)
        for value, at in ((r.like_1, like), (r.like_2, like - dt.timedelta(days=lb.SEASON))):
            seen = [y for d, y in by[r.uf] if d <= at]
            there = any(d == at for d, _ in by[r.uf])
            assert value == pytest.approx(np.mean(seen[-3:]) - r.base) if there else value is None
        truth = dict(by[r.uf]).get(r.date)
        assert r.label is None if r.test else r.label == pytest.approx(truth - r.base)


def test_a_week_of_an_unknown_level_is_not_forecast(spark):
    got = lb.learned_forecasts(table(spark, [("A", START, 3), ("A", START + dt.timedelta(weeks=300), 5)]), SEASONS, s=SMALL, **MODELS)
    assert got.where("model = 'quantile_trees'").count() == 0


def test_halving_finds_what_a_full_search_finds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    y = np.where(x[:, 0] > 0, 3.0, 0.0) + np.where(x[:, 1] > 0, 1.0, 0.0) + rng.normal(size=600) * 0.2
    df = spark.createDataFrame([(*map(float, r), float(v), i) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, y double, i int")
    grid = [b.Booster(str(k), depth=d, rate=r) for k, (d, r) in enumerate([(1, 0.02), (1, 0.1), (2, 0.05), (2, 0.5)])]
    train, held = df.where("i < 400"), df.where("i >= 400")
    halved = tuning.successive_halving(train, held, ["a", "b"], "y", grid, [2, 8], 1 / 2).collect()
    full = tuning.successive_halving(train, held, ["a", "b"], "y", grid, [8], 1).collect()
    assert len(halved) == 6 and len(full) == 4
    best = min(full, key=lambda r: (r.score, r.trial))
    assert [r.trial for r in halved if r.rung == 1 and r.kept] == [best.trial] == [r.trial for r in full if r.kept]
    assert {r.trial: r.score for r in halved if r.rung == 1}[best.trial] == pytest.approx(best.score)
    one = b.fit(train, ["a", "b"], "y", [b.Booster("x", depth=2, rate=0.5, rounds=8)])
    told = np.array([r._pred[0] for r in b.predict(held, one, ["i"]).orderBy("i").collect()])
    assert full[3].score == pytest.approx(np.abs(y[400:] - told).mean() / 2) and json.loads(full[3].params)["depth"] == 2


def test_ridge_as_a_callback_equals_the_built_in(spark, rows):
    def ridge_objective(rows, params):
        x, y = np.array(rows["_x"].tolist()), rows["_ly"].to_numpy()
        train, held = (rows["split"] == v for v in ("train", "validation"))
        beta = ln.make_ridge()(x[train].T @ x[train], x[train].T @ y[train], train.sum(), params["penalty"])
        return float(np.sqrt(np.mean((y[held] - x[held] @ beta) ** 2)))

    df = table(spark, rows)
    grid = [{"penalty": 1e-4}, {"penalty": 1.0}]
    design = {"terms": [(365.25, 1)], "changepoints": 1}
    want = {(r.uf, r.trial): r.score for r in ln.tune_seasonal(df, grid, s=SMALL, **design).collect()}
    made = ln.seasonal_design(time_split(df.withColumn("_ly", F.log1p("casos")), 0.2, SMALL), SMALL, **design).select("uf", "split", "_ly", "_x")
    got = {(r.uf, r.trial): r.score for r in tuning.run_trials(made, grid, ridge_objective).collect()}
    assert got == pytest.approx(want)


def test_failures_and_large_groups_become_rows(spark):
    def picky(rows, params):
        if params["fail"]:
            raise ValueError("no thanks")
        return float("nan") if params["nan"] else float(len(rows))

    df = spark.createDataFrame([("A", i) for i in range(5)] + [("B", i) for i in range(50)] + [(None, 1)], "uf string, v int")
    trials = [{"fail": False, "nan": False}, {"fail": True, "nan": False}, {"fail": False, "nan": True}]
    got = {(r.uf, r.trial): (r.score, r.error) for r in tuning.run_trials(df, trials, picky, max_rows=10).collect()}
    assert got["A", 0] == (5.0, None) and got["A", 1] == (None, "ValueError: no thanks") and got["A", 2][0] is None
    assert got[None, 0] == (1.0, None)
    assert all(got["B", k] == (None, "group has 50 rows, the bound is 10") for k in range(3)) and len(got) == 9


def test_models_per_fold(spark):
    class Mean:
        def fit(self, x, y):
            self.value = y.mean()

        def predict(self, x):
            return np.full(len(x), self.value)

    rows = [("A", 0, "train", 1.0, 2.0), ("A", 0, "train", 1.0, 4.0), ("A", 0, "test", 1.0, 7.0), ("A", 0, "test", None, 100.0), ("B", 0, "train", 1.0, 2.0)]
    got = {r.uf: (r.rmse, r.error) for r in tuning.fold_scores(spark.createDataFrame(rows, "uf string, fold int, role string, x double, y double"), Mean, ["x"], "y").collect()}
    assert got["A"] == (4.0, None) and got["B"][0] is None and "no complete rows" in got["B"][1]
