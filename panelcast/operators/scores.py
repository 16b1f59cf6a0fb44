"""Scores of point and interval forecasts.

A forecast table has the truth beside ``median`` and ``lower_L``/``upper_L`` columns.
Every score is a row expression averaged per group, so one aggregation with map-side
combine yields all of them, however unevenly rows spread over groups.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import ratio

LEVELS = [50, 80, 95]
ALL_LEVELS = [50, 80, 90, 95]

# Quantile level of each forecast column.
QUANTILE_COLUMNS = {
    "lower_95": 0.025,
    "lower_90": 0.05,
    "lower_80": 0.10,
    "lower_50": 0.25,
    "median": 0.50,
    "upper_50": 0.75,
    "upper_80": 0.90,
    "upper_90": 0.95,
    "upper_95": 0.975,
}

# The columns the CRPS uses unless told otherwise.
CRPS_COLUMNS = ["lower_95", "lower_50", "median", "upper_50", "upper_95"]

MAPE_EPSILON = 1e-8
MIN_SCALE = 1e-6


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mape(y: Column, p: Column, epsilon: float = MAPE_EPSILON) -> Column:
    return F.avg(F.abs((y - p) / (F.abs(y) + F.lit(epsilon)))) * 100.0


def bias(y: Column, p: Column) -> Column:
    return F.avg(p - y)


def crps_row(y: Column, quantiles: list[tuple[float, Column]]) -> Column:
    """Quantile score of one row from ``(level, value)`` pairs.

    Kept in the historical form: its segment part carries squared units and may be
    negative. ``pinball_row`` is the proper score.
    """
    pairs = sorted(quantiles, key=lambda p: p[0])
    parts = []
    for (q0, v0), (q1, v1) in zip(pairs, pairs[1:]):
        past_low = (y - v0) * F.when(y >= v0, q0 * q0).otherwise((q0 - 1.0) ** 2)
        past_high = (y - v1) * F.when(y < v1, (1.0 - q1) ** 2).otherwise(q1 * q1)
        parts.append((v1 - v0) * (past_low + past_high))
    parts += [_pinball(y, q, v) * 2.0 for q, v in pairs]
    return _total(parts) / F.lit(float(len(pairs)))


def _pinball(y: Column, q: float, v: Column) -> Column:
    return F.when(y >= v, (y - v) * q).otherwise((v - y) * (1.0 - q))


def pinball_row(y: Column, quantiles: list[tuple[float, Column]]) -> Column:
    """Twice the mean pinball loss: a CRPS estimate in the units of ``y``."""
    return _total([_pinball(y, q, v) for q, v in quantiles]) * (2.0 / len(quantiles))


def wis_row(y: Column, lower: Column, upper: Column, median: Column, alpha: float) -> Column:
    below = F.greatest(lower - y, F.lit(0.0))
    above = F.greatest(y - upper, F.lit(0.0))
    return (upper - lower) * (alpha / 2.0) + (below + above) * (2.0 / alpha) + F.abs(y - median)


def log_score_row(y: Column, median: Column, scale: Column, proper: bool = False) -> Column:
    """Negative log density of a normal forecast; as handed down, ``ln(scale)`` enters
    with a minus sign unless ``proper``."""
    s = F.greatest(scale, F.lit(MIN_SCALE))
    z = (y - median) / s
    density = z * z / 2.0 + 0.5 * math.log(2.0 * math.pi)
    return density + F.ln(s) if proper else density - F.ln(s)


def inside(y: Column, lower: Column, upper: Column) -> Column:
    """1.0 or 0.0 by whether the truth lies in the interval, bounds included."""
    return ((y >= lower) & (y <= upper)).cast("double")


def levels_of(df: DataFrame, levels: list[int]) -> list[int]:
    return [n for n in levels if {f"lower_{n}", f"upper_{n}"} <= set(df.columns)]


def quantiles_of(df: DataFrame, names: list[str] | None = None) -> list[tuple[float, Column]]:
    wanted = names or CRPS_COLUMNS
    return [(QUANTILE_COLUMNS[c], _d(c)) for c in wanted if c in df.columns]


def wis_total_row(df: DataFrame, y: Column, levels: list[int], weights: list[float] | None = None) -> Column:
    """Weighted mean of the interval scores of the levels present; equal weights if none given."""
    weights = weights or [1.0 / len(levels)] * len(levels)
    if len(weights) != len(levels):
        raise ValueError("one weight per level")
    present = [(n, w) for n, w in zip(levels, weights) if n in levels_of(df, levels)]
    if not present:
        return F.lit(None).cast("double")
    parts = [
        wis_row(y, _d(f"lower_{n}"), _d(f"upper_{n}"), _d("median"), 1.0 - n / 100.0) * w
        for n, w in present
    ]
    return _total(parts) / F.lit(sum(w for _, w in present))


def score_aggregates(df: DataFrame, truth: str = "casos", levels: list[int] = LEVELS) -> dict[str, Column]:
    y, m = _d(truth), _d("median")
    out = {"rmse": rmse(y, m), "mae": mae(y, m), "mape": mape(y, m), "bias": bias(y, m)}
    for n in levels_of(df, levels):
        lower, upper = _d(f"lower_{n}"), _d(f"upper_{n}")
        out[f"coverage_{n}"] = F.avg(inside(y, lower, upper))
        out[f"wis_{n}"] = F.avg(wis_row(y, lower, upper, m, 1.0 - n / 100.0))
        out[f"width_{n}"] = F.avg(upper - lower)
    q = quantiles_of(df)
    null = F.lit(None).cast("double")
    out["crps"] = F.avg(crps_row(y, q)) if q else null
    out["crps_pinball"] = F.avg(pinball_row(y, q)) if q else null
    out["wis_total"] = F.avg(wis_total_row(df, y, levels))
    return out


def evaluate(
    df: DataFrame, by: list[str], truth: str = "casos", levels: list[int] = LEVELS, count: bool = False
) -> DataFrame:
    """All scores per group, over rows that have a median."""
    made = [c.alias(n) for n, c in score_aggregates(df, truth, levels).items()]
    if count:
        made.append(F.count(F.lit(1)).alias("n_rows"))
    return df.where(F.col("median").isNotNull()).groupBy(*by).agg(*made)


def sharpness(df: DataFrame, by: list[str], level: int, truth: str = "casos") -> DataFrame:
    """Mean interval width, absolute and relative to ``max(truth, 1)``."""
    width = _d(f"upper_{level}") - _d(f"lower_{level}")
    return df.groupBy(*by).agg(
        F.avg(width).alias("sharpness"),
        F.avg(width / F.greatest(_d(truth), F.lit(1.0))).alias("relative_sharpness"),
    )


def log_score(df: DataFrame, by: list[str], scale: str, truth: str = "casos", proper: bool = False) -> DataFrame:
    row = log_score_row(_d(truth), _d("median"), _d(scale), proper)
    return df.groupBy(*by).agg(F.avg(row).alias("log_score"))


SKILL = {"rmse": rmse, "mae": mae, "mape": mape}


def skill_score(
    df: DataFrame,
    baseline: str,
    metric: str = "rmse",
    keys: tuple[str, ...] = ("uf", "date"),
    by: tuple[str, ...] = ("uf",),
    truth: str = "casos",
    model: str = "model",
) -> DataFrame:
    """``1 - model/baseline`` per group and model, on rows both forecast."""
    if metric not in SKILL:
        raise ValueError(f"unknown metric: {metric}")
    base = df.where(F.col(model) == baseline).select(*keys, F.col("median").alias("_base"))
    paired = df.where(F.col(model) != baseline).join(base, list(keys), "inner")
    score = SKILL[metric]
    y = _d(truth)
    return (
        paired.groupBy(*by, model)
        .agg(score(y, _d("median")).alias("_m"), score(y, _d("_base")).alias("_b"))
        .select(*by, model, (F.lit(1.0) - ratio(F.col("_m"), F.col("_b"))).alias("skill"))
    )


def coverage_errors(
    df: DataFrame, by: list[str], truth: str = "casos", levels: list[int] = ALL_LEVELS
) -> DataFrame:
    """Distance of empirical from nominal coverage per level, over rows with bounds."""
    made = []
    for n in levels_of(df, levels):
        hit = F.when(F.col(f"lower_{n}").isNotNull(), inside(_d(truth), _d(f"lower_{n}"), _d(f"upper_{n}")))
        made.append(F.abs(F.avg(hit) - F.lit(n / 100.0)).alias(f"coverage_error_{n}"))
    return df.groupBy(*by).agg(*made)


def by_level(df: DataFrame, keep: list[str], levels: list[int]) -> DataFrame:
    """One row per interval level with ``level, lower, upper``."""
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("level"), _d(f"lower_{n}").alias("lower"), _d(f"upper_{n}").alias("upper"))
            for n in levels_of(df, levels)
        ]
    )
    return df.select(*keep, F.inline(cells))


def interval_validation(
    df: DataFrame, by: list[str], truth: str = "casos", levels: list[int] = ALL_LEVELS
) -> DataFrame:
    """Per level: expected and actual coverage, misses on either side, mean width."""
    y = _d(truth)
    long = by_level(df, [*by, truth], levels).where(F.col("lower").isNotNull())
    expected = F.col("level") / F.lit(100.0)
    return (
        long.groupBy(*by, "level")
        .agg(
            F.avg(inside(y, F.col("lower"), F.col("upper"))).alias("actual_coverage"),
            F.count_if(y < F.col("lower")).alias("n_below"),
            F.count_if(y > F.col("upper")).alias("n_above"),
            F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
        )
        .withColumn("expected_coverage", expected)
        .withColumn("coverage_error", F.abs(F.col("actual_coverage") - expected))
    )


def validation_passed(
    metrics: DataFrame,
    by: list[str],
    max_crps: float = 100.0,
    min_coverage: float = 0.85,
    levels: list[int] = ALL_LEVELS,
) -> DataFrame:
    """Whether every model stays under the CRPS limit and near its nominal coverage."""
    ok = F.coalesce(F.col("crps") <= max_crps, F.lit(False))
    for n in levels:
        if f"coverage_{n}" in metrics.columns:
            ok = ok & F.coalesce(F.col(f"coverage_{n}") >= F.lit(min_coverage * n / 100.0), F.lit(True))
    return metrics.groupBy(*by).agg(F.bool_and(ok).alias("passed"))


def overfitting(
    train: DataFrame,
    validation: DataFrame,
    on: list[str],
    threshold: float = 0.3,
    metrics: tuple[str, ...] = ("rmse", "mae", "crps"),
) -> DataFrame:
    """Validation-to-train ratio per metric and whether any exceeds ``1 + threshold``."""
    t = train.select(*on, *[F.col(m).alias(f"train_{m}") for m in metrics])
    v = validation.select(*on, *[F.col(m).alias(f"val_{m}") for m in metrics])
    joined = t.join(v, on)
    ratios = {
        m: F.when(F.col(f"train_{m}") > 0, ratio(F.col(f"val_{m}"), F.col(f"train_{m}"))) for m in metrics
    }
    any_over = reduce(
        lambda a, b: a | b,
        [F.coalesce(r > F.lit(1.0 + threshold), F.lit(False)) for r in ratios.values()],
    )
    return joined.select(
        *on, *[r.alias(f"ratio_{m}") for m, r in ratios.items()], any_over.alias("overfitting")
    )


# Metrics of the leaderboard; coverage ranks high to low, the rest low to high.
LEADERBOARD = ["rmse", "mae", "mape", "crps", "wis_total"]


def long_metrics(metrics: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    present = [n for n in names if n in metrics.columns]
    return metrics.unpivot(keep, present, "metric", "value").where(F.col("value").isNotNull())


def best_model(metrics: DataFrame, by: list[str], metric: str = "crps") -> DataFrame:
    """The model with the lowest score per group; ties go to the first name."""
    return metrics.where(F.col(metric).isNotNull()).groupBy(*by).agg(
        F.min_by("model", F.struct(F.col(metric), F.col("model"))).alias("best_model"),
        F.min(metric).alias("best_score"),
    )


def best_per_metric(metrics: DataFrame, names: list[str]) -> DataFrame:
    long = long_metrics(metrics, ["model"], names)
    return long.groupBy("metric").agg(
        F.min_by("model", F.struct("value", "model")).alias("best_model"), F.min("value").alias("best_value")
    )


def leaderboard(metrics: DataFrame, levels: list[int] = LEVELS) -> DataFrame:
    """Rank of every model for every metric. ``metrics`` has one row per model."""
    from pyspark.sql import Window

    names = LEADERBOARD + [f"coverage_{n}" for n in levels]
    long = long_metrics(metrics, ["model"], names)
    direction = F.when(F.col("metric").startswith("coverage_"), -F.col("value")).otherwise(F.col("value"))
    order = Window.partitionBy("metric").orderBy(direction, "model")
    return long.withColumn("rank", F.row_number().over(order))
