"""Trend-and-season regression with further regressors and changepoints that the data choose.

An elastic net is fitted per series from the sums X'X, X'y, y'y alone, so the rows are read once however
many penalties are tried. Changepoints get the absolute penalty, which sets most of them to zero; season
and regressors get the squared one, which only shrinks them.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import week_of_epiweek
from panelcast.operators.groups import attach
from panelcast.operators.learned import SEASONAL_TERMS, moments, predict_linear, residual_intervals, seasonal_design
from panelcast.operators.scores import QUANTILE_COLUMNS
from panelcast.series import Series
from panelcast.session import cut_lineage

CANDIDATES = 12


def make_elastic_net():
    # nested, so that it travels to the executors with the UDF that uses it
    def elastic_net(xx, xy, yy: float, n: float, lasso, ridge, rounds: int = 2_000) -> np.ndarray:
        """Coefficients of all features, the first of which is the intercept.

        Features and target are brought to mean 0 and deviation 1, so a penalty is on the scale of
        correlations: ``lasso`` 1 leaves no feature. Both are one number or one per feature without the
        intercept. Coordinates descend until the active ones and their signs solve the problem exactly.
        A feature that does not vary gets 0.
        """
        p = len(xy)
        beta = np.zeros(p)
        if p == 0 or n <= 0:
            return np.full(p, np.nan)
        square = np.reshape(np.asarray(xx, dtype=float), (p, p)) / n
        mean, level = square[0], xy[0] / n
        cov = square - np.outer(mean, mean)
        cross = np.asarray(xy, dtype=float) / n - mean * level
        var, spread = np.diag(cov)[1:], yy / n - level**2
        use = 1 + np.flatnonzero(var > 1e-12 * np.diag(square)[1:])
        beta[0] = level
        if spread <= 1e-12 * yy / n or not len(use):
            return beta
        sd, sy = np.sqrt(np.diag(cov)[use]), math.sqrt(spread)
        g, r = cov[np.ix_(use, use)] / np.outer(sd, sd), cross[use] / (sd * sy)
        l1 = np.broadcast_to(np.asarray(lasso, dtype=float), (p - 1,))[use - 1]
        l2 = np.broadcast_to(np.asarray(ridge, dtype=float), (p - 1,))[use - 1]
        b, full = np.zeros(len(use)), np.diag(g) + l2
        for step in range(rounds):
            for j in range(len(use)):
                rest = r[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = math.copysign(max(abs(rest) - l1[j], 0.0), rest) / full[j]
            if step % 10 == 9:
                on = np.flatnonzero(b != 0)
                sign = np.sign(b[on])
                exact = np.zeros(len(use))
                exact[on] = np.linalg.lstsq(g[np.ix_(on, on)] + np.diag(l2[on]), r[on] - l1[on] * sign, rcond=None)[0]
                off = np.abs(r - g @ exact - l2 * exact) <= l1 + 1e-10
                if off.all() and ((np.sign(exact[on]) == sign) | (l1[on] == 0)).all():
                    b = exact
                    break
        beta[use] = b * sy / sd
        beta[0] = level - mean[use] @ beta[use]
        return beta

    return elastic_net


def fit_elastic_net(sums: DataFrame, by: tuple[str, ...], lasso: float | list[float], ridge: float | list[float]) -> DataFrame:
    """``beta`` per group from its moments; penalties as in ``make_elastic_net``."""
    net = make_elastic_net()

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([net(*row, lasso, ridge) for row in zip(xx, xy, yy, n)], dtype="object")

    return sums.select(*by, solve("xx", "xy", "yy", "n").alias("beta"))


def search_elastic_net(train: DataFrame, held_out: DataFrame, by: tuple[str, ...], grid: list[dict]) -> DataFrame:
    """Held-out RMSE (``score``) of every ``{"lasso": .., "ridge": ..}`` per group, from moments alone."""
    net = make_elastic_net()
    trials = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(json.dumps(g, sort_keys=True)).alias("params")) for i, g in enumerate(grid)]))
    a, b = (d.select(*by, F.struct("xx", "xy", "yy", "n").alias(name)) for d, name in ((train, "fit"), (held_out, "held")))

    @F.pandas_udf("double")
    def error(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series, hxx: pd.Series, hxy: pd.Series, hyy: pd.Series, hn: pd.Series, params: pd.Series) -> pd.Series:
        out = []
        for *fit, sxx, sxy, syy, m, g in zip(xx, xy, yy, n, hxx, hxy, hyy, hn, params):
            g = json.loads(g)
            beta = net(*fit, g["lasso"], g["ridge"])
            sse = syy - 2 * beta @ np.asarray(sxy) + beta @ np.reshape(sxx, (len(beta), -1)) @ beta
            out.append(math.sqrt(max(sse, 0.0) / max(m, 1.0)))
        return pd.Series(out, dtype="float64")

    parts = [f"{side}.{c}" for side in ("fit", "held") for c in ("xx", "xy", "yy", "n")]
    return a.join(b, list(by)).select("*", trials.alias("c")).select(*by, "c.trial", "c.params", error(*parts, "c.params").alias("score"))


def expected_by_week(df: DataFrame, columns: list[str], train_end: str, s: Series = Series(), epiweek: str = "epiweek") -> DataFrame:
    """Add ``<column>_expected``: the mean of the series in that week of the year up to ``train_end``.

    It is known for any later week, so a regression on it uses nothing after the cutoff. A week of the
    year that training does not have gets the series' mean.
    """
    week = week_of_epiweek(F.col(epiweek))
    past = df.where(F.col(s.time) <= F.lit(train_end).cast("date")).select(*s.key, week.alias("_week"), *columns)
    weekly = past.groupBy(*s.key, "_week").agg(*[F.avg(c).alias(f"_w_{c}") for c in columns])
    overall = past.groupBy(*s.key).agg(*[F.avg(c).alias(f"_a_{c}") for c in columns])
    rows = attach(attach(df.withColumn("_week", week), weekly, [*s.key, "_week"], [s.time]), overall, list(s.key), [s.time])
    made = {f"{c}_expected": F.coalesce(f"_w_{c}", f"_a_{c}") for c in columns}
    return rows.withColumns(made).select(*df.columns, *made)


def _design(df: DataFrame, regressors: list[str], train_end: str, terms, changepoints: int, s: Series) -> tuple[DataFrame, list[str]]:
    rows = seasonal_design(df, s, terms, changepoints, until=train_end)
    width = rows.schema["_x"].metadata["width"] + len(regressors)
    x = F.concat("_x", F.array(*[F.col(c).cast("double") for c in regressors]).cast("array<double>")).alias("_x", metadata={"width": width})
    waves = [f"{f}_{period:g}_{k}" for period, harmonics in terms for k in range(1, harmonics + 1) for f in ("sin", "cos")]
    names = ["intercept", "trend", *[f"changepoint_{i}" for i in range(1, changepoints + 1)], *waves, *regressors]
    return rows.select(*[c for c in rows.columns if c != "_x"], x), names


def _penalties(names: list[str], lasso: float, ridge: float) -> tuple[list[float], list[float]]:
    bends = [n.startswith("changepoint_") for n in names[1:]]
    return [lasso if b else 0.0 for b in bends], [0.0 if b else ridge for b in bends]


def _fitted(df: DataFrame, train_end: str, regressors, target: str, lasso: float, ridge: float, terms, changepoints: int, s: Series):
    """Rows with features, and the coefficients per series learned up to ``train_end``."""
    logs = df.withColumn("_ly", F.log1p(F.col(target).cast("double")))
    rows, names = _design(logs, list(regressors), train_end, terms, changepoints, s)
    train = rows.where(F.col(s.time) <= F.lit(train_end).cast("date"))
    sums = moments(train, "_ly", s.key, s)
    return rows, names, cut_lineage(fit_elastic_net(sums, s.key, *_penalties(names, lasso, ridge)))


def trend_regression(
    df: DataFrame,
    train_end: str,
    regressors: list[str] = (),
    target: str = "casos",
    lasso: float = 0.01,
    ridge: float = 1e-4,
    terms: list[tuple[float, int]] = SEASONAL_TERMS,
    changepoints: int = CANDIDATES,
    s: Series = Series(),
) -> DataFrame:
    """Forecasts of log cases by trend, chosen changepoints, season and ``regressors`` after ``train_end``.

    Regressors are columns known when a row is forecast, such as ``expected_by_week``. Rows without one of
    them do not enter the fit and get no forecast, as do rows of a series with no training row.
    """
    rows, _, betas = _fitted(df, train_end, regressors, target, lasso, ridge, terms, changepoints, s)
    until = F.lit(train_end).cast("date")
    fitted = predict_linear(rows, betas, s.key, "_yhat", s).where(F.col("_yhat").isNotNull() & ~F.isnan("_yhat"))
    residual = fitted.where(F.col(s.time) <= until).select(*s.key, (F.col("_ly") - F.col("_yhat")).alias("_res"))
    out = residual_intervals(fitted.where(F.col(s.time) > until), residual, s.key, "_yhat", F.expm1, s)
    return out.select(*s.key, s.time, F.lit("trend_regression").alias("model"), target, *QUANTILE_COLUMNS)


def trend_coefficients(
    df: DataFrame,
    train_end: str,
    regressors: list[str] = (),
    target: str = "casos",
    lasso: float = 0.01,
    ridge: float = 1e-4,
    terms: list[tuple[float, int]] = SEASONAL_TERMS,
    changepoints: int = CANDIDATES,
    s: Series = Series(),
) -> DataFrame:
    """A row per series and feature: ``feature``, ``coefficient``, and whether it was ``chosen`` (is not 0)."""
    _, names, betas = _fitted(df, train_end, regressors, target, lasso, ridge, terms, changepoints, s)
    named = betas.select(*s.key, F.posexplode("beta").alias("_i", "coefficient"))
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    return named.select(*s.key, feature.alias("feature"), "coefficient", (F.col("coefficient") != 0).alias("chosen"))
