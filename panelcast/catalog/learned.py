"""Learned models: backtests, recursive forecasts, importances, search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.forecasts import DESIGN
from panelcast.catalog.registry import register
from panelcast.functions.scalar import cycle
from panelcast.operators import boosting
from panelcast.operators import features as ft
from panelcast.operators.forecasts import cv_folds
from panelcast.operators.scores import ALL_LEVELS, QUANTILE_COLUMNS, evaluate
from panelcast.plans import learned_backtest as lb
from panelcast.plans import selection as v
from panelcast.plans import tuning
from panelcast.plans.backtest import score_seasons
from panelcast.series import Series, over_chunks
from panelcast.session import cut_lineage

TREES = {"rounds": 10, "depth": 3}
LAST = [x for x in t.SEASONS if x[2] == t.TRAIN_END]


def _forecasts(s, d):
    """Forecasts of all models for all tests, made once per session."""
    return t.stored(s, d, "learned", lambda: lb.learned_forecasts(t.stored_state(s, d), t.SEASONS, trees=TREES, regression=DESIGN))


def _scores(s, d):
    return t.stored(s, d, "learned scores", lambda: score_seasons(_forecasts(s, d), t.stored_state(s, d)))


def _with_truth(s, d):
    """Forecasts of the last test, by every model, with the truth where the week has been observed."""
    last = _forecasts(s, d).where(F.col("test") == LAST[0][0])
    joined = last.join(t.stored_state(s, d).select("uf", "date", "casos"), ["uf", "date"], "left")
    return joined.select("uf", "date", "model", "casos", *QUANTILE_COLUMNS)


def _selected(s, d):
    """Per state the forecasts of the models chosen for it, scored: what a run would train and use."""
    chosen = v.select_top_models(_scores(s, d), n_top=2)
    ahead = lb.selected_forecasts(_forecasts(s, d), chosen)
    seen = ahead.join(t.stored_state(s, d).select("uf", "date", "casos"), ["uf", "date"])
    return evaluate(seen, ["uf", "rank", "model"], levels=ALL_LEVELS)


register("q1_boosted_trees", lambda s, d: _with_truth(s, d).where(F.col("model") == "quantile_trees"))
register("q9_all_model_forecasts", _with_truth)
register("v1_backtest_learned", _scores)
register("v6_select_top_learned", lambda s, d: v.select_top_models(_scores(s, d), n_top=2))
register("q14_selected_models_of_states", _selected)

# a regression on one column, which SQL has: the trend of log cases per state and test
_TRAIN = "(SELECT f.uf, z.test, f.date, f.date - DATE '1990-01-01' AS x, ln(1 + f.casos) AS ly FROM fx_state f JOIN fx_seasons z ON f.date <= z.train_end)"
_FIT = f"(SELECT uf, test, regr_slope(ly, x) AS b, regr_intercept(ly, x) AS a FROM {_TRAIN} GROUP BY uf, test)"
_SPREAD = f"(SELECT uf, test, {', '.join(f'quantile_cont(ly - a - b * x, {q}) AS r_{c}' for c, q in QUANTILE_COLUMNS.items())} FROM {_TRAIN} JOIN {_FIT} USING (uf, test) GROUP BY uf, test)"
_BOUNDS = ", ".join("greatest(exp(yhat) - 1, 0) AS median" if c == "median" else f"greatest(exp(yhat + r_{c}) - 1, 0) AS {c}" for c in QUANTILE_COLUMNS)
TREND = f"""(SELECT uf, test, date, {_BOUNDS} FROM (SELECT uf, test, date, a + b * (date - DATE '1990-01-01') AS yhat
    FROM fx_weeks JOIN {_FIT} USING (uf, test) WHERE test <> 'final') JOIN {_SPREAD} USING (uf, test))"""


def _trend(s, d):
    panel = t.stored_state(s, d)
    return score_seasons(lb.regression_forecasts(panel, t.SEASONS, penalty=0.0, terms=[], changepoints=0), panel)


register("v1_backtest_trend", _trend,
    f"SELECT uf, test, 'seasonal_regression' AS model, {t.score_sql(ALL_LEVELS)} FROM {TREND} JOIN fx_state USING (uf, date) GROUP BY uf, test", t.SCORE_NAMES)

# ---- recursion ------------------------------------------------------------------------------

LAGS, MEANS = (1, 2, 4, 52), (4, 12)


def _one_step(s, d):
    """A booster that looks one week ahead in log cases, relative to the mean of the last four weeks."""
    rows = t.stored_state(s, d).select("uf", "date", F.log1p(F.col("casos").cast("double")).alias("ly"))

    def past(w):
        out = {f"lag_{k}": F.lag("ly", k).over(w) for k in LAGS}
        return out | {f"mean_{n}": F.avg("ly").over(w.rowsBetween(-n, -1)) for n in MEANS}

    made = over_chunks(rows, past, before=max(LAGS))
    week_sin, week_cos = cycle(F.weekofyear("date"), 52)
    relative = {f"lag_{k}": F.col(f"lag_{k}") - F.col("mean_4") for k in LAGS} | {"mean_12": F.col("mean_12") - F.col("mean_4")}
    made = made.withColumns({**relative, "week_sin": week_sin, "week_cos": week_cos, "label": F.col("ly") - F.col("mean_4")})
    names = [*relative, "week_sin", "week_cos"]
    return rows, boosting.fit(made, names, "label", [boosting.Booster("one step", rounds=10)])


def _recursive_trees(s, d):
    rows, model = _one_step(s, d)

    def mean(past, n):
        return F.aggregate(F.slice(past, -n, n), F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))

    def value(past, date):
        base = mean(past, 4)
        x = [*(F.element_at(past, -k) - base for k in LAGS), mean(past, 12) - base, *cycle(F.weekofyear(date), 52)]
        return base + boosting.expression(model, model.ensembles[0], F.array(*x))

    ahead = boosting.recursive(rows, ["uf"], "date", "ly", max(LAGS), 52, value)
    return ahead.withColumn("median", F.greatest(F.expm1("median"), F.lit(0.0)))


register("q8_recursive_trees", _recursive_trees)

# ---- importances ----------------------------------------------------------------------------


def _medians(s, d):
    return lb.fit_direct(t.stored_state(s, d), t.SEASONS, levels={"median": 0.5}, **TREES)


def _gains(s, d):
    _, model = _medians(s, d)
    return boosting.gain_importances(boosting.nodes(s, model))


def _moved(s, d):
    rows, model = _medians(s, d)
    return boosting.permutation_importances(rows.where("label is not null"), model, "label")


register("a9_tree_gain_importance", _gains)
register("a9_tree_permutation_importance", _moved)
register("o2_top_tree_features", lambda s, d: _gains(s, d).orderBy(F.col("importance").desc(), "feature").limit(4))

# ---- search ---------------------------------------------------------------------------------


def _halving(s, d):
    rows = cut_lineage(lb.direct_rows(t.stored_state(s, d), LAST).where("test is null"))
    year_before = F.date_sub(F.lit(t.TRAIN_END).cast("date"), lb.SEASON)
    grid = [boosting.Booster(f"{depth}/{rate}", depth=depth, rate=rate) for depth in (1, 2, 3) for rate in (0.1, 0.4)]
    return tuning.successive_halving(rows.where(F.col("date") <= year_before), rows.where(F.col("origin") > year_before), lb.FEATURES, "label", grid, [2, 6, 12], 1 / 2)


def _moving_average(rows, params):
    """A user's objective: RMSE of the mean of the last ``window`` weeks."""
    y = rows.sort_values("date")["casos"].to_numpy(float)
    n = params["window"]
    told = np.convolve(y, np.ones(n) / n, "valid")[:-1]
    return float(np.sqrt(np.mean((y[n:] - told) ** 2)))


class Line:
    """A user's model: least squares on the features."""

    def fit(self, x, y):
        self.beta = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]

    def predict(self, x):
        return np.column_stack([np.ones(len(x)), x]) @ self.beta


WINDOWS = (2, 8, 26)


def _folds(s, d):
    rows = ft.lag_features(t.stored_state(s, d).select("uf", "date", "casos"), lags=[1])
    return cv_folds(rows, s=Series())


register("q11_successive_halving", _halving)
register("x5_user_objective",
    lambda s, d: tuning.run_trials(t.stored_state(s, d).select("uf", "date", "casos"), [{"window": n} for n in WINDOWS], _moving_average).select("uf", "trial", "score"),
    " UNION ALL ".join(f"""SELECT uf, CAST({i} AS INTEGER) AS trial, sqrt(avg((casos - told) * (casos - told))) AS score FROM
        (SELECT uf, casos, avg(casos) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS told, row_number() OVER w AS r FROM fx_state WINDOW w AS (PARTITION BY uf ORDER BY date))
        WHERE r > {n} GROUP BY uf""" for i, n in enumerate(WINDOWS)), "score")
register("x6_user_model_per_fold",
    lambda s, d: tuning.fold_scores(_folds(s, d), Line, ["casos_lag_1"], "casos").select("uf", "fold", "rmse"),
    """WITH rows AS (SELECT uf, casos, x, CAST(i AS INTEGER) AS fold, CASE WHEN idx < start - 4 THEN 'train' ELSE 'test' END AS role
        FROM (SELECT *, n - (5 - i) * (n // 6) AS start, n // 6 AS size FROM
              (SELECT uf, casos, lag(casos) OVER (PARTITION BY uf ORDER BY date) AS x, row_number() OVER (PARTITION BY uf ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY uf) AS n FROM fx_state),
              range(0, 5) AS k(i))
        WHERE idx < start - 4 OR (idx >= start AND idx < start + size)),
        lines AS (SELECT uf, fold, regr_slope(casos, x) AS b, regr_intercept(casos, x) AS a FROM rows WHERE role = 'train' AND x IS NOT NULL GROUP BY uf, fold)
        SELECT uf, fold, sqrt(avg((casos - a - b * x) * (casos - a - b * x))) AS rmse FROM rows JOIN lines USING (uf, fold) WHERE role = 'test' AND x IS NOT NULL GROUP BY uf, fold""", "rmse")
