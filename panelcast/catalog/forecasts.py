"""Forecast tables, splits, sequences and learned models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.prep import sparse
from panelcast.catalog.registry import register
from panelcast.operators import elastic as el
from panelcast.operators import features as ft
from panelcast.operators import forecasts as f
from panelcast.operators import learned as ln
from panelcast.operators.scores import ALL_LEVELS, QUANTILE_COLUMNS, evaluate
from panelcast.plans import report as r
from panelcast.plans import selection as sel
from panelcast.session import cut_lineage

BOUNDS = [c for n in ALL_LEVELS for c in (f"lower_{n}", f"upper_{n}")]
Z = {50: 0.67449, 80: 1.28155, 90: 1.64485, 95: 1.95996}


def _state(s, d):
    return t.stored_state(s, d).select("uf", "date", "casos")


register("q10_baseline_forecasts", lambda s, d: t.forecast(s, d), "SELECT * FROM fx_forecast", ["median", *BOUNDS, "sd"])
register("q3_gaussian_from_interval",
    lambda s, d: f.gaussian_from_interval(t.forecast(s, d).drop("sd")),
    "SELECT uf, date, model, casos, median, " + ", ".join(
        f"median - {z} * (upper_80 - lower_80) / (2 * 1.28) AS lower_{n}, median + {z} * (upper_80 - lower_80) / (2 * 1.28) AS upper_{n}"
        for n, z in Z.items()) + " FROM fx_forecast", ["median", *BOUNDS])
register("q4_sequence_windows",
    lambda s, d: f.sequence_windows(_state(s, d), ["casos"]).select("uf", "date", F.size("sequence").alias("n"),
        F.element_at("sequence", 1)["casos"].alias("oldest"), F.element_at("sequence", -1)["casos"].alias("newest"),
        F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["casos"]).alias("total"), "y"),
    """SELECT uf, date, CAST(52 AS INTEGER) AS n, CAST(lag(casos, 52) OVER w AS DOUBLE) AS oldest, CAST(lag(casos, 1) OVER w AS DOUBLE) AS newest,
       CAST(sum(casos) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS DOUBLE) AS total, casos AS y
       FROM fx_state WINDOW w AS (PARTITION BY uf ORDER BY date) QUALIFY row_number() OVER w > 52""", "oldest newest total")
register("q5_reduce_samples", lambda s, d: f.reduce_samples(cut_lineage(t.samples(s, d))),
    "SELECT uf, date, avg(value) AS mean, stddev_pop(value) AS std, " + ", ".join(
        f"quantile_cont(value, {q}) AS {c}" for c, q in QUANTILE_COLUMNS.items()) + " FROM fx_samples GROUP BY uf, date",
    ["mean", "std", *QUANTILE_COLUMNS])
register("q6_widen_intervals", lambda s, d: f.widen_intervals(t.forecast(s, d).select("uf", "date", "model", "median", "lower_80", "upper_80")),
    """SELECT uf, date, model, median, lower_80, upper_80, lower_80 * 1.1 AS lower_95, lower_80 * 0.7 AS lower_50,
       upper_80 * 0.7 AS upper_50, upper_80 * 1.1 AS upper_95 FROM fx_forecast""",
    "median lower_80 upper_80 lower_95 lower_50 upper_50 upper_95", digits=8)
register("q7_select_levels", lambda s, d: f.select_levels(t.forecast(s, d), [80, 95]),
    "SELECT uf, date, model, median, lower_80, upper_80, lower_95, upper_95 FROM fx_forecast",
    "median lower_80 upper_80 lower_95 upper_95")
register("q7_quantile_long", lambda s, d: f.quantile_long(t.forecast(s, d)),
    " UNION ALL ".join(f"SELECT uf, date, model, {q}::DOUBLE AS quantile, {c} AS value FROM fx_forecast" for c, q in QUANTILE_COLUMNS.items()),
    "quantile value")
register("f13_clip_intervals",
    lambda s, d: f.clip_intervals(f.gaussian_from_interval(t.forecast(s, d).select("uf", "date", "model", "median", "lower_80", "upper_80"))),
    "SELECT uf, date, model, greatest(median, 0) AS median, " + ", ".join(
        f"greatest(median - {z} * (upper_80 - lower_80) / (2 * 1.28), 0) AS lower_{n}, median + {z} * (upper_80 - lower_80) / (2 * 1.28) AS upper_{n}"
        for n, z in Z.items()) + " FROM fx_forecast", ["median", *BOUNDS])
register("f16_softplus_normalize", lambda s, d: f.softplus_normalize(_state(s, d)),
    """SELECT uf, date, casos, ln(1 + exp((casos - avg(casos) OVER w) / (stddev_samp(casos) OVER w + 1e-8))) AS casos_softplus
       FROM fx_state WINDOW w AS (PARTITION BY uf)""", "casos_softplus")
register("w11_time_fraction_split", lambda s, d: f.time_split(_state(s, d)),
    """SELECT uf, date, casos, CASE WHEN row_number() OVER (PARTITION BY uf ORDER BY date) <= floor(count(*) OVER (PARTITION BY uf) * (1 - 0.2::DOUBLE))
       THEN 'train' ELSE 'validation' END AS split FROM fx_state""")
register("w12_cv_folds", lambda s, d: f.cv_folds(_state(s, d)),
    """SELECT uf, date, casos, CAST(i AS INTEGER) AS fold, CASE WHEN idx < start - 4 THEN 'train' ELSE 'test' END AS role
       FROM (SELECT *, n - (5 - i) * (n // 6) AS start, n // 6 AS size FROM
             (SELECT uf, date, casos, row_number() OVER (PARTITION BY uf ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY uf) AS n FROM fx_state),
             range(0, 5) AS k(i))
       WHERE idx < start - 4 OR (idx >= start AND idx < start + size)""")
register("w9_w10_softplus_inputs", lambda s, d: f.softplus_normalize(ft.encoder_rows(_state(s, d), 52)).drop("casos"),
    """SELECT uf, date, time_idx, ln(1 + exp((casos - avg(casos) OVER w) / (stddev_samp(casos) OVER w + 1e-8))) AS casos_softplus FROM
       (SELECT *, max(time_idx) OVER (PARTITION BY uf) AS last FROM
        (SELECT *, CAST((date - min(date) OVER (PARTITION BY uf)) // 7 AS INTEGER) AS time_idx FROM fx_state))
       WHERE time_idx <= last - 52 WINDOW w AS (PARTITION BY uf)""", "casos_softplus")


def _fold_metrics(s, d):
    df = cut_lineage(t.forecast(s, d))
    folds = f.cv_folds(df, s=ft.Series(key=("uf", "model")))
    return evaluate(folds.where(F.col("role") == "test"), ["uf", "model", "fold"])


FOLDS = f"""(SELECT uf, model, i AS fold, {t.score_sql([50, 80, 95])} FROM
    (SELECT *, n - (5 - i) * (n // 6) AS start, n // 6 AS size FROM
     (SELECT *, row_number() OVER (PARTITION BY uf, model ORDER BY date) - 1 AS idx, count(*) OVER (PARTITION BY uf, model) AS n FROM fx_forecast),
     range(0, 5) AS k(i)) WHERE idx >= start AND idx < start + size GROUP BY uf, model, i)"""
for _name, _std in (("sample", "stddev_samp"), ("population", "stddev_pop")):
    register(f"a10_cv_summary_{_name}_std", lambda s, d, k=_name: f.cv_summary(_fold_metrics(s, d), ["uf", "model"], k == "sample"),
        f"""SELECT uf, model, avg(crps) AS crps_mean, {_std}(crps) AS crps_std, avg(rmse) AS rmse_mean, avg(mae) AS mae_mean,
            avg(coverage_95) AS coverage_95_mean, count(*) AS n_splits FROM {FOLDS} GROUP BY uf, model""",
        "crps_mean crps_std rmse_mean mae_mean coverage_95_mean")


# ---- learned models --------------------------------------------------------------------

DESIGN = {"terms": [(365.25, 4), (91.25, 1)], "changepoints": 4}


def _seasonal(s, d):
    return ln.seasonal_regression(_state(s, d), t.TRAIN_END, **DESIGN)


def _trials(s, d):
    grid = [{"penalty": p, "columns": k} for p in (1e-4, 1e-2, 1.0) for k in (2, 6, 16)]
    return ln.tune_seasonal(_state(s, d), grid, **DESIGN)


def _ar_forecast(s, d):
    df = _state(s, d)
    return ln.recursive_forecast(df, ln.first_order_coefficients(df), [1], 8)


def _lagged_forecast(s, d):
    df = _state(s, d)
    lags = [1, 2, 4, 52]
    rows = ln.lag_design(ft.lag_features(df, lags=lags), [f"casos_lag_{k}" for k in lags])
    betas = ln.fit_linear(ln.moments(rows, "casos", ("uf",)), ("uf",), 1e-3)
    return ln.recursive_forecast(df, betas, lags, 52)


def _expected(s, d):
    """The climate that each week of the year had in training."""
    return cut_lineage(el.expected_by_week(sparse(s, d), ["temp_med"], t.TRAIN_END))


def _net_rows(s, d):
    return ln.lag_design(ft.lag_features(_state(s, d), lags=[1, 52]), ["casos_lag_1", "casos_lag_52"])


def _net_search(s, d):
    """Trained on rows up to the cutoff, scored on later ones."""
    rows, grid = _net_rows(s, d), [{"lasso": a, "ridge": b} for a in (0.0, 0.05, 0.2) for b in (0.0, 0.1)]
    past = F.col("date") <= F.lit(t.TRAIN_END).cast("date")
    train, held = (cut_lineage(ln.moments(rows.where(w), "casos", ("uf",))) for w in (past, ~past))
    return el.search_elastic_net(train, held, ("uf",), grid)


# coordinate descent of two features on the scale of correlations; a feature or target that does not vary counts 0
ELASTIC = """SELECT uf, my - b1 * sy / s1 * m1 - b2 * sy / s2 * m2 AS intercept, b1 * sy / s1 AS lag_1, b2 * sy / s2 AS lag_52 FROM (
     WITH RECURSIVE c AS (SELECT uf, avg(casos) AS my, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(casos) AS sy,
             CASE WHEN stddev_pop(x1) > 0 THEN stddev_pop(x1) ELSE 1 END AS s1, CASE WHEN stddev_pop(x2) > 0 THEN stddev_pop(x2) ELSE 1 END AS s2,
             CASE WHEN stddev_pop(casos) > 0 AND stddev_pop(x1) > 0 THEN corr(casos, x1) ELSE 0 END AS r1,
             CASE WHEN stddev_pop(casos) > 0 AND stddev_pop(x2) > 0 THEN corr(casos, x2) ELSE 0 END AS r2,
             CASE WHEN stddev_pop(x1) > 0 AND stddev_pop(x2) > 0 THEN corr(x1, x2) ELSE 0 END AS g
         FROM (SELECT uf, casos, lag(casos, 1) OVER w AS x1, lag(casos, 52) OVER w AS x2 FROM fx_state WINDOW w AS (PARTITION BY uf ORDER BY date))
         WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY uf),
     r AS (SELECT *, 0 AS i, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2 FROM c
           UNION ALL SELECT uf, my, m1, m2, sy, s1, s2, r1, r2, g, i + 1, n1,
               sign(r2 - g * n1) * greatest(abs(r2 - g * n1) - 0.05, 0) / 1.1
           FROM (SELECT *, sign(r1 - g * b2) * greatest(abs(r1 - g * b2) - 0.05, 0) / 1.1 AS n1 FROM r WHERE i < 200))
     SELECT * FROM r WHERE i = 200)"""

register("q2_seasonal_regression", _seasonal)
register("q2_elastic_net_two_columns",
    lambda s, d: el.fit_elastic_net(ln.moments(_net_rows(s, d), "casos", ("uf",)), ("uf",), 0.05, 0.1).select(
        "uf", F.col("beta")[0].alias("intercept"), F.col("beta")[1].alias("lag_1"), F.col("beta")[2].alias("lag_52")),
    ELASTIC, "intercept lag_1 lag_52")
register("q2_trend_with_regressors",
    lambda s, d: el.trend_regression(_expected(s, d), t.TRAIN_END, ["temp_med_expected"], terms=DESIGN["terms"], changepoints=8))
register("q2_chosen_changepoints",
    lambda s, d: el.trend_coefficients(_expected(s, d), t.TRAIN_END, ["temp_med_expected"], terms=DESIGN["terms"], changepoints=8))
register("q11_elastic_net_search", _net_search)
register("q8_recursive_first_order", _ar_forecast,
    """SELECT uf, CAST(step AS INTEGER) AS step, date, median FROM (
         WITH RECURSIVE c AS (SELECT uf, regr_slope(casos, x) AS b, regr_intercept(casos, x) AS a, max_by(casos, date) AS y, max(date) AS last
             FROM (SELECT *, lag(casos, 1) OVER (PARTITION BY uf ORDER BY date) AS x FROM fx_state) GROUP BY uf),
         r AS (SELECT uf, 0 AS step, CAST(y AS DOUBLE) AS median, last AS date, a, b FROM c
               UNION ALL SELECT uf, step + 1, a + b * median, CAST(date + 7 AS DATE), a, b FROM r WHERE step < 8)
         SELECT * FROM r WHERE step > 0)""", "median")
register("q8_recursive_many_lags", _lagged_forecast)
register("q11_grid_search_trials", _trials)
register("q11_best_parameters", lambda s, d: ln.best_trial(_trials(s, d), ("uf",)))
register("q12_convergence", lambda s, d: sel.convergence(_trials(s, d), ("uf",), "trial", patience=3, min_iterations=3))
register("q12_convergence_over_tests",
    lambda s, d: sel.convergence(t.tests(s, d).select("uf", "model", "test", F.col("mae").alias("score")), ("uf", "model"), "test", patience=9, min_improvement=0.0),
    "SELECT uf, model, min(mae) AS best_score, CAST(count(*) AS INTEGER) AS iterations, false AS converged FROM fx_tests GROUP BY uf, model", "best_score")
register("q14_models_of_all_states",
    lambda s, d: evaluate(_seasonal(s, d), ["uf", "model"], levels=ALL_LEVELS))
register("x5_objective_per_parameter_set",
    lambda s, d: _trials(s, d).groupBy("params").agg(F.avg("score").alias("mean_score")))
register("x6_model_per_fold", lambda s, d: ln.cross_validate(_state(s, d), **DESIGN))

IMPORTANCE = """(UNPIVOT (SELECT model, {parts} FROM fx_forecast GROUP BY model) ON {names} INTO NAME feature VALUE importance)"""


def _importances(s, d):
    """Absolute correlation of each quantile column with the truth, per model."""
    names = ["median", *BOUNDS]
    wide = t.forecast(s, d).groupBy("model").agg(*[F.abs(F.corr(c, F.col("casos").cast("double"))).alias(c) for c in names])
    return wide.unpivot(["model"], names, "feature", "importance")


IMPORTANCE_SQL = IMPORTANCE.format(
    parts=", ".join(f"abs(corr({c}, casos)) AS {c}" for c in ["median", *BOUNDS]), names=", ".join(["median", *BOUNDS]))
register("a9_importance_mean", lambda s, d: r.importance_mean(_importances(s, d)),
    f"SELECT feature, avg(importance) AS importance FROM {IMPORTANCE_SQL} GROUP BY feature", "importance")
register("o2_top_features", lambda s, d: r.importance_mean(_importances(s, d), 4),
    f"SELECT feature, avg(importance) AS importance FROM {IMPORTANCE_SQL} GROUP BY feature ORDER BY importance DESC, feature LIMIT 4", "importance")
register("u2_concat_of_parts",
    lambda s, d: t.forecast(s, d).where(F.col("model") == "naive").select("uf", "date", "median").unionByName(
        t.forecast(s, d).where(F.col("model") == "seasonal").select("uf", "date", "median", "lower_50"), allowMissingColumns=True),
    """SELECT uf, date, median, CAST(NULL AS DOUBLE) AS lower_50 FROM fx_forecast WHERE model = 'naive'
       UNION ALL SELECT uf, date, median, lower_50 FROM fx_forecast WHERE model = 'seasonal'""", "median lower_50")
register("u1_date_intersection",
    lambda s, d: t.forecast(s, d).where(F.col("model") == "seasonal").select("uf", "date").intersect(_state(s, d).where(F.col("casos") > 1).select("uf", "date")),
    "SELECT uf, date FROM fx_forecast WHERE model = 'seasonal' INTERSECT SELECT uf, date FROM fx_state WHERE casos > 1")
register("j7_align_forecast_observations",
    lambda s, d: t.forecast(s, d).drop("casos").join(_state(s, d).where(F.col("casos") > 1), ["uf", "date"]).select("uf", "date", "model", "median", "casos"),
    "SELECT uf, date, model, median, casos FROM fx_forecast WHERE casos > 1", "median")
register("j8_align_models",
    lambda s, d: t.forecast(s, d).groupBy("uf", "date").agg(*[F.max(F.when(F.col("model") == k, F.col("median"))).alias(k) for k in ("naive", "seasonal", "mean12")]),
    "SELECT uf, date, " + ", ".join(f"max(CASE WHEN model = '{k}' THEN median END) AS {k}" for k in ("naive", "seasonal", "mean12")) + " FROM fx_forecast GROUP BY uf, date",
    "naive seasonal mean12")
