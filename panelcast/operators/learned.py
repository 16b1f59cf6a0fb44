"""Learned forecasts: linear models per series, boosted trees over all series, search.

A linear model needs no more of the data than the sums X'X, X'y, y'y. They are plain
aggregates with map-side combine, so a long series spreads over tasks, and make one
small system per series. The same sums of held-out rows give the error of any candidate
model without another pass over the data, which makes grid search cheap.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import at_least, cycle
from panelcast.operators.groups import attach, group_quantiles, top_per_group
from panelcast.operators.scores import QUANTILE_COLUMNS
from panelcast.series import Series
from panelcast.session import cut_lineage, shared_folder

# Seasonal terms, as (period in days, number of harmonics).
SEASONAL_TERMS = [(365.25, 10), (91.25, 4)]
CHANGEPOINTS = 8
CHANGEPOINT_SHARE = 0.8


def seasonal_design(
    df: DataFrame,
    s: Series = Series(),
    terms: list[tuple[float, int]] = SEASONAL_TERMS,
    changepoints: int = CHANGEPOINTS,
    until: str | None = None,
    known: Column | None = None,
) -> DataFrame:
    """Add ``_x``: intercept, trend with changepoints, and Fourier terms of the date.

    Time runs from 0 to 1 over each series' rows up to ``until``, or those that ``known`` holds for (all
    rows if both are None); changepoints lie evenly in the first four fifths of that.
    """
    if until is not None:
        known = F.col(s.time) <= F.lit(until).cast("date")
    past = df if known is None else df.where(known)
    span = past.groupBy(*s.key).agg(F.min(s.time).alias("_t0"), F.max(s.time).alias("_t1"))
    rows = attach(df, span, list(s.key), [s.time])
    t = F.datediff(s.time, "_t0") / F.greatest(F.datediff("_t1", "_t0"), F.lit(1))
    x: list[Column] = [F.lit(1.0), t]
    for i in range(1, changepoints + 1):
        x.append(F.greatest(t - F.lit(CHANGEPOINT_SHARE * i / changepoints), F.lit(0.0)))
    day = F.unix_date(s.time).cast("double")
    for period, harmonics in terms:
        for k in range(1, harmonics + 1):
            x += list(cycle(day, period / k))
    return rows.select("*", _features(x)).drop("_t0", "_t1")


def _log_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("_ly", F.log1p(F.col(target).cast("double")))


def lag_design(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``_x``: intercept and the given columns."""
    return df.select("*", _features([F.lit(1.0), *[F.col(c).cast("double") for c in columns]]))


def _features(x: list[Column]) -> Column:
    """``_x``, whose length the schema tells."""
    return F.array(*x).alias("_x", metadata={"width": len(x)})


def moments(df: DataFrame, y: str, by: tuple[str, ...], s: Series = Series()) -> DataFrame:
    """Per group the sums ``n, yy, xy, xx`` (row-major) over rows with a target and complete features.

    Sums of products are plain aggregates: tasks add up their own rows before anything is shuffled, so a
    group of any size costs one short row per task. ``_x`` comes from a design.
    """
    rows = df.select(*by, "_x", F.col(y).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    rows = rows.where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))))
    p = df.schema["_x"].metadata["width"]
    x = [F.col("_x")[i] for i in range(p)]
    sums = {f"_c{i}": F.sum(c) for i, c in enumerate([F.lit(1.0), F.col("_y") * F.col("_y"), *[v * F.col("_y") for v in x], *[x[i] * x[j] for i in range(p) for j in range(i, p)]])}
    at = {(i, j): f"_c{2 + p + i * p - i * (i - 1) // 2 + j - i}" for i in range(p) for j in range(i, p)}
    whole = rows.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    square = F.array(*[F.col(at[min(i, j), max(i, j)]) for i in range(p) for j in range(p)])
    return whole.select(*by, F.col("_c0").alias("n"), F.col("_c1").alias("yy"), F.array(*[F.col(f"_c{2 + i}") for i in range(p)]).alias("xy"), square.alias("xx"))


def make_ridge():
    # nested, so that it travels to the executors with the UDF that uses it
    def ridge(xx: np.ndarray, xy: np.ndarray, n: float, penalty: float) -> np.ndarray:
        """Coefficients with all but the intercept shrunk; least-norm when singular."""
        p = len(xy)
        shrink = np.eye(p) * penalty * max(n, 1.0)
        shrink[0, 0] = 0.0
        return np.linalg.lstsq(np.asarray(xx).reshape(p, p) + shrink, np.asarray(xy), rcond=None)[0]

    return ridge


def fit_linear(sums: DataFrame, by: tuple[str, ...], penalty: float = 1e-4) -> DataFrame:
    """``beta`` per group from its moments."""
    ridge = make_ridge()

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([ridge(a, b, c, penalty) for a, b, c in zip(xx, xy, n)])

    return sums.select(*by, solve("xx", "xy", "n").alias("beta"))


def predict_linear(df: DataFrame, betas: DataFrame, by: tuple[str, ...], out: str, s: Series = Series()) -> DataFrame:
    rows = attach(df, betas, list(by), [s.time])
    products = F.zip_with("_x", "beta", lambda a, b: a * b)
    return rows.withColumn(out, F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)).drop("beta")


def residual_intervals(
    df: DataFrame, residual: DataFrame, by: tuple[str, ...], center: str, back=lambda c: c, s: Series = Series()
) -> DataFrame:
    """Quantile columns: ``center`` plus the group's empirical residual quantiles, mapped
    back to the scale of the target and kept non-negative."""
    levels = {f"_r_{c}": q for c, q in QUANTILE_COLUMNS.items()}
    quantiles = group_quantiles(residual, list(by), "_res", levels)
    rows = attach(df, quantiles, list(by), [s.time])
    made = {c: at_least(back(F.col(center) + F.coalesce(F.col(f"_r_{c}"), F.lit(0.0)))) for c in QUANTILE_COLUMNS}
    # the median is the model's own prediction
    made["median"] = at_least(back(F.col(center)))
    return rows.withColumns(made).drop(*levels)


def seasonal_regression(
    df: DataFrame,
    train_end: str,
    target: str = "casos",
    penalty: float = 1e-4,
    s: Series = Series(),
    **design,
) -> DataFrame:
    """Trend-and-season regression of log cases, one model per series, fitted on rows up
    to ``train_end`` and forecast with intervals for the rows after it."""
    train_until = F.lit(train_end).cast("date")
    rows = seasonal_design(_log_target(df, target), s, until=train_end, **design)
    train = rows.where(F.col(s.time) <= train_until)
    # a few numbers per series, used three times below
    betas = cut_lineage(fit_linear(moments(train, "_ly", s.key, s), s.key, penalty))
    fitted = predict_linear(rows, betas, s.key, "_yhat", s)
    residual = fitted.where((F.col(s.time) <= train_until) & F.col("_yhat").isNotNull()).select(
        *s.key, (F.col("_ly") - F.col("_yhat")).alias("_res")
    )
    ahead = fitted.where((F.col(s.time) > train_until) & F.col("_yhat").isNotNull())
    out = residual_intervals(ahead, residual, s.key, "_yhat", F.expm1, s)
    return out.select(*s.key, s.time, F.lit("seasonal_regression").alias("model"), target, *QUANTILE_COLUMNS)


def boosted_trees(
    df: DataFrame,
    features: list[str],
    train_end: str,
    target: str = "casos",
    validation: float = 0.2,
    s: Series = Series(),
    **params,
) -> DataFrame:
    """One boosted-tree model over all series with empirical intervals per series, for features that are
    known when a row is forecast. With lags of a week it looks one week ahead; see ``plans.learned_backtest``
    for forecasts that know nothing after a cutoff.

    The series enters as its mean target in training, so the number of series does not
    enlarge the model. The last ``validation`` share of each series' training rows stays
    out of the fit; the quantiles of its residuals make the intervals.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from panelcast.operators.forecasts import time_split

    past = time_split(df.where(F.col(s.time) <= F.lit(train_end).cast("date")), validation, s)
    future = df.where(F.col(s.time) > F.lit(train_end).cast("date")).withColumn("split", F.lit("forecast"))
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        # boosting cuts the lineage of its running residuals there
        context.setCheckpointDir(shared_folder(df.sparkSession))
    # boosting reads its input once per tree level: write the features once
    rows = cut_lineage(past.unionByName(future))
    means = rows.where(F.col("split") == "train").groupBy(*s.key).agg(F.avg(target).alias("_key_mean"))
    names = [*features, "_key_mean"]
    # trees split on a value far outside every range as they would on "missing"
    known = attach(rows, means, list(s.key), [s.time]).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0e9)) for c in names}
    )
    # rows to forecast stay, whether or not their target is known
    known = known.withColumn("_label", F.col(target).cast("double")).where(F.col("_label").isNotNull() | (F.col("split") == "forecast"))
    vectors = VectorAssembler(inputCols=names, outputCol="_features").transform(known)
    settings = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 7, **params}
    trees = GBTRegressor(featuresCol="_features", labelCol="_label", predictionCol="_yhat", **settings)
    model = trees.fit(vectors.where(F.col("split") == "train"))
    # written, so that the trees run once for residuals and forecasts together
    scored = cut_lineage(model.transform(vectors).select(*s.key, s.time, target, "split", "_label", "_yhat"))
    residual = scored.where(F.col("split") == "validation").select(*s.key, (F.col("_label") - F.col("_yhat")).alias("_res"))
    ahead = scored.where(F.col("split") == "forecast")
    out = residual_intervals(ahead, residual, s.key, "_yhat", s=s)
    return out.select(*s.key, s.time, F.lit("boosted_trees").alias("model"), target, *QUANTILE_COLUMNS)


def recursive_forecast(
    df: DataFrame,
    coefficients: DataFrame,
    lags: list[int],
    n_weeks: int,
    target: str = "casos",
    s: Series = Series(),
) -> DataFrame:
    """Multi-step forecasts that feed each prediction back as a lag.

    ``coefficients`` has ``beta`` per series: intercept, then one per lag. Only the last
    ``max(lags)`` rows of a series matter; Spark keeps just those per task before the
    shuffle, and the recursion is a fold over the steps inside one row.
    """
    depth = max(lags)
    recent = top_per_group(
        df.where(F.col(target).isNotNull()).select(*s.key, s.time, target), list(s.key), [F.col(s.time).desc()], depth
    )
    point = F.struct(F.col(s.time).alias("t"), F.col(target).cast("double").alias("y"))
    history = recent.groupBy(*s.key).agg(
        F.sort_array(F.collect_list(point)).alias("_p"), F.max(s.time).alias("_last")
    )
    # a series with too few rows or without coefficients gets its dates with a NULL forecast
    rows = attach(history, coefficients, list(s.key), ["_last"])
    able = (F.size("_p") == depth) & F.col("beta").isNotNull()

    def step(past: Column, _: Column) -> Column:
        value = F.col("beta")[0]
        for i, k in enumerate(lags, 1):
            value = value + F.col("beta")[i] * F.element_at(past, -k)
        return F.concat(past, F.array(value))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(n_weeks)), F.transform("_p", lambda p: p["y"]), step)
    none = F.array_repeat(F.lit(None).cast("double"), n_weeks)
    ahead = F.when(able, F.slice(path, depth + 1, n_weeks)).otherwise(none)
    return rows.select(*s.key, "_last", F.posexplode(ahead).alias("_i", "median")).select(
        *s.key,
        (F.col("_i") + 1).alias("step"),
        F.date_add("_last", ((F.col("_i") + 1) * 7).cast("int")).alias(s.time),
        "median",
    )


def first_order_coefficients(df: DataFrame, target: str = "casos", s: Series = Series()) -> DataFrame:
    """Regression of each value on the one before it, as ``beta``."""
    from panelcast.operators.features import lag_features

    rows = lag_features(df.select(*s.key, s.time, target), target, [1], s)
    y, x = F.col(target), F.col(f"{target}_lag_1")
    return rows.groupBy(*s.key).agg(F.array(F.regr_intercept(y, x), F.regr_slope(y, x)).alias("beta"))


def grid_search(
    train: DataFrame, held_out: DataFrame, by: tuple[str, ...], grid: list[dict]
) -> DataFrame:
    """Held-out RMSE of every parameter set per group, from moments alone.

    A parameter set is ``{"penalty": .., "columns": k}``; ``columns`` keeps the first
    ``k`` features.
    """
    ridge = make_ridge()
    candidates = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(json.dumps(g, sort_keys=True)).alias("params")) for i, g in enumerate(grid)]))
    joined = train.select(*by, F.col("xx").alias("a"), F.col("xy").alias("b"), F.col("n").alias("m")).join(
        held_out, list(by)
    )

    @F.pandas_udf("double")
    def error(a: pd.Series, b: pd.Series, m: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series, params: pd.Series) -> pd.Series:
        out = []
        for row in zip(a, b, m, xx, xy, yy, n, params):
            g = json.loads(row[7])
            p = len(row[1])
            k = int(min(g.get("columns", p), p))
            beta = ridge(np.reshape(row[0], (p, p))[:k, :k], np.asarray(row[1])[:k], row[2], g["penalty"])
            sse = row[5] - 2 * beta @ np.asarray(row[4])[:k] + beta @ np.reshape(row[3], (p, p))[:k, :k] @ beta
            out.append(math.sqrt(max(sse, 0.0) / max(row[6], 1.0)))
        return pd.Series(out)

    return (
        joined.select("*", candidates.alias("c"))
        .select(*by, "c.trial", "c.params", error("a", "b", "m", "xx", "xy", "yy", "n", "c.params").alias("score"))
    )


def best_trial(trials: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return trials.groupBy(*by).agg(
        F.min_by("params", F.struct("score", "trial")).alias("params"), F.min("score").alias("score")
    )


def tune_seasonal(
    df: DataFrame,
    grid: list[dict],
    validation: float = 0.2,
    target: str = "casos",
    s: Series = Series(),
    **design,
) -> DataFrame:
    """Every trial's score per series for the seasonal regression, validated on the last
    part of each series."""
    from panelcast.operators.forecasts import time_split

    rows = seasonal_design(time_split(_log_target(df, target), validation, s), s, **design)
    sums = cut_lineage(moments(rows, "_ly", (*s.key, "split"), s))
    train = sums.where(F.col("split") == "train").drop("split")
    held = sums.where(F.col("split") == "validation").drop("split")
    return grid_search(train, held, s.key, grid)


def cross_validate(
    df: DataFrame, n_splits: int = 5, gap: int = 4, penalty: float = 1e-4, target: str = "casos", s: Series = Series(), **design
) -> DataFrame:
    """Held-out RMSE of the seasonal regression per series and expanding-window fold."""
    from panelcast.operators.forecasts import cv_folds

    rows = seasonal_design(cv_folds(_log_target(df, target), n_splits, gap, s), s, **design)
    by = (*s.key, "fold")
    sums = cut_lineage(moments(rows, "_ly", (*by, "role"), s))
    train = sums.where(F.col("role") == "train").drop("role")
    test = sums.where(F.col("role") == "test").drop("role")
    return grid_search(train, test, by, [{"penalty": penalty}]).select(*by, F.col("score").alias("rmse"))
