"""Weighting, combining and conformally calibrating the forecasts of several models.

Models are aligned by key and date, never by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalar import ratio
from panelcast.operators.forecasts import clip_intervals
from panelcast.operators.groups import attach, group_quantiles
from panelcast.operators.scores import ALL_LEVELS, LEVELS, evaluate, levels_of
from panelcast.session import cut_lineage

EPSILON = 1e-8
METRICS = ("crps", "crps_pinball", "rmse", "mae")


def _columns(df: DataFrame, levels: list[int]) -> list[str]:
    return ["median"] + [c for n in levels_of(df, levels) for c in (f"lower_{n}", f"upper_{n}")]


def fit_weights(
    df: DataFrame, metric: str = "crps_pinball", by: tuple[str, ...] = ("uf",), truth: str = "casos"
) -> DataFrame:
    """Weights inverse to each model's score, summing to one per group.

    Scores at or below zero, which ``crps`` can produce, have no inverse weight: such
    models get NULL and the others share the weight.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown weight metric: {metric}")
    scores = evaluate(df, [*by, "model"], truth).select(*by, "model", F.col(metric).alias("score"))
    inverse = scores.withColumn("_i", F.when(F.col("score") >= 0, F.lit(1.0) / (F.col("score") + EPSILON)))
    # one row per model: a group is as large as the model count
    total = F.sum("_i").over(Window.partitionBy(*by))
    return inverse.select(*by, "model", "score", ratio(F.col("_i"), total).alias("weight"))


def set_weights(weights: DataFrame, overrides: dict[str, float], by: tuple[str, ...] = ("uf",)) -> DataFrame:
    """Replace the weights of the named models, then renormalize. Unknown names are ignored."""
    value = F.col("weight")
    for name, w in overrides.items():
        value = F.when(F.col("model") == name, F.lit(float(w))).otherwise(value)
    changed = weights.withColumn("weight", value)
    total = F.sum("weight").over(Window.partitionBy(*by))
    return changed.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))


def weighted_average(
    df: DataFrame,
    weights: DataFrame | None = None,
    keys: tuple[str, ...] = ("uf", "date"),
    weight_keys: tuple[str, ...] = ("uf", "model"),
    levels: list[int] = ALL_LEVELS,
    strict: bool = False,
) -> DataFrame:
    """Weighted mean of every forecast column over the models of a row.

    A model without a value is left out and the rest renormalized; with ``strict`` it
    counts as zero, and a NULL value of any model makes the result NULL. Without
    ``weights`` all models count alike.
    """
    if weights is None:
        rows = df.withColumn("_w", F.lit(1.0))
    else:
        rows = attach(df, weights.select(*weight_keys, F.col("weight").alias("_w")), list(weight_keys), [keys[-1]])
    w = F.coalesce(F.col("_w"), F.lit(0.0))
    made = []
    for c in _columns(df, levels):
        value = F.col(c).cast("double")
        mean = ratio(F.sum(w * value), F.sum(F.when(value.isNotNull(), w)))
        if strict:
            mean = F.when(F.count(value) == F.count(F.lit(1)), ratio(F.sum(w * value), F.sum(w)))
        made.append(mean.alias(c))
    return rows.groupBy(*keys).agg(*made)


def median_ensemble(
    df: DataFrame, keys: tuple[str, ...] = ("uf", "date"), levels: list[int] = ALL_LEVELS
) -> DataFrame:
    """Median over models of every forecast column; a group is as large as the model count."""
    return df.groupBy(*keys).agg(*[F.median(c).alias(c) for c in _columns(df, levels)])


def combine(df: DataFrame, method: str = "weighted_average", weights: DataFrame | None = None, **kw) -> DataFrame:
    """Combine models and clip at zero. ``stacking`` is the weighted average."""
    if method in ("weighted_average", "stacking"):
        out = weighted_average(df, weights, **kw)
    elif method == "median":
        out = median_ensemble(df, **kw)
    else:
        raise ValueError(f"unknown method: {method}")
    return clip_intervals(out)


def conformal_level(n: Column, p: float) -> Column:
    """``ceil((n+1)·p)/n``, at most 0.999."""
    # p is a whole percent: multiply first so that exact products stay exact
    reach = F.ceil((n + 1) * F.lit(round(p * 100)) / F.lit(100.0)) / n
    return F.least(reach, F.lit(0.999))


def calibrate(
    df: DataFrame,
    by: tuple[str, ...] = ("uf",),
    truth: str = "casos",
    levels: list[int] = LEVELS,
    standard: bool = False,
) -> DataFrame:
    """Correction per group and level from the misses of the intervals.

    By default the absolute distances of both bounds to the truth are pooled. With
    ``standard`` the score of a row is the larger signed miss, as in conformalized
    quantile regression.
    """
    y = F.col(truth).cast("double")
    cells = []
    for n in levels_of(df, levels):
        low, high = F.col(f"lower_{n}") - y, y - F.col(f"upper_{n}")
        scores = F.array(F.greatest(low, high)) if standard else F.array(F.abs(low), F.abs(high))
        cells.append(F.struct(F.lit(n).alias("_level"), scores.alias("_s")))
    residuals = (
        df.where(F.col("median").isNotNull())
        .select(*by, F.inline(F.array(*cells)))
        .select(*by, "_level", F.explode("_s").alias("_r"))
    )
    # every level of every group, of which each group keeps its own
    names = {f"c{n}": n / 100.0 for n in levels_of(df, levels)}
    found = group_quantiles(residuals, [*by, "_level"], "_r", names, conformal_level)
    return found.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_level") == n, F.col(f"c{n}"))).alias(f"correction_{n}")
            for n in levels_of(df, levels)
        ]
    )


def apply_calibration(
    df: DataFrame, corrections: DataFrame, by: tuple[str, ...] = ("uf",), time: str = "date"
) -> DataFrame:
    """Widen every interval by its correction; groups without one are unchanged."""
    rows = attach(df, corrections, list(by), [time])
    moved: dict[str, Column] = {}
    for name in corrections.columns:
        if name.startswith("correction_"):
            n = name.removeprefix("correction_")
            if f"lower_{n}" in df.columns:
                step = F.coalesce(F.col(name), F.lit(0.0))
                moved[f"lower_{n}"] = F.col(f"lower_{n}") - step
                moved[f"upper_{n}"] = F.col(f"upper_{n}") + step
    return rows.withColumns(moved).select(*df.columns)


def ensemble(
    df: DataFrame,
    truth: str | None = None,
    method: str = "weighted_average",
    metric: str = "crps_pinball",
    calibrated: bool = True,
    by: tuple[str, ...] = ("uf",),
    time: str = "date",
    levels: list[int] = LEVELS,
) -> DataFrame:
    """Equal weights without a truth; with one, fit weights, combine and calibrate."""
    keys = (*by, time)
    if truth is None:
        return combine(df, method, keys=keys, levels=levels)
    # the forecasts are read for the weights, the combination and the truth
    df = cut_lineage(df)
    if method == "median":
        combined = combine(df, method, keys=keys, levels=levels)
    else:
        weights = fit_weights(df, metric, by, truth)
        combined = combine(df, method, weights, keys=keys, weight_keys=(*by, "model"), levels=levels)
    if not calibrated:
        return combined
    combined = cut_lineage(combined)
    observed = df.groupBy(*keys).agg(F.max(truth).alias(truth))
    corrections = calibrate(combined.join(observed, list(keys)), by, truth, levels)
    return apply_calibration(combined, corrections, by, time)


def compare_methods(
    df: DataFrame,
    methods: tuple[str, ...] = ("weighted_average", "median"),
    truth: str = "casos",
    by: tuple[str, ...] = ("uf",),
    time: str = "date",
    weights: DataFrame | None = None,
) -> DataFrame:
    """Scores of each combination method."""
    keys = (*by, time)
    df = cut_lineage(df)
    observed = df.groupBy(*keys).agg(F.max(truth).alias(truth))
    tables = []
    for m in methods:
        extra = {"weight_keys": (*by, "model")} if m != "median" else {}
        made = combine(df, m, weights if m != "median" else None, keys=keys, **extra)
        tables.append(made.withColumn("method", F.lit(m)))
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    return evaluate(union.join(observed, list(keys)), ["method"], truth)
