"""Forecast tables: baselines, interval derivations, sample reduction, splits, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalar import at_least
from panelcast.operators.groups import attach, group_quantiles
from panelcast.operators.scores import ALL_LEVELS, QUANTILE_COLUMNS
from panelcast.series import Series, over_chunks, positions

# Standard normal quantile of the upper end of each central interval.
Z = {50: 0.67449, 80: 1.28155, 90: 1.64485, 95: 1.95996}


def gaussian_bounds(center: Column, spread: Column, levels: list[int] = ALL_LEVELS, clip: bool = False) -> dict[str, Column]:
    """``center ∓ z·spread`` for each level; ``clip`` raises lower bounds to zero."""
    out = {}
    for n in levels:
        lower = center - F.lit(Z[n]) * spread
        out[f"lower_{n}"] = F.greatest(lower, F.lit(0.0)) if clip else lower
        out[f"upper_{n}"] = center + F.lit(Z[n]) * spread
    return out


def baseline_forecasts(
    df: DataFrame,
    target: str = "casos",
    season: int = 52,
    window: int = 12,
    s: Series = Series(),
) -> DataFrame:
    """Naive, seasonal-naive and moving-average forecasts with normal intervals.

    All three come from one pass over the series; each row then yields one row per model.
    """

    def build(w: Window) -> dict[str, Column]:
        past = w.rowsBetween(-window, -1)
        y = F.col(target).cast("double")
        return {
            "_naive": F.lag(y, 1).over(w),
            "_seasonal": F.lag(y, season).over(w),
            "_mean": F.avg(y).over(past),
            "_sd": F.stddev_samp(y).over(past),
        }

    rows = over_chunks(df.select(*s.key, s.time, target), build, s, before=max(season, window))
    models = F.array(
        F.struct(F.lit("naive").alias("model"), F.col("_naive").alias("median")),
        F.struct(F.lit("seasonal").alias("model"), F.col("_seasonal").alias("median")),
        F.struct(F.lit(f"mean{window}").alias("model"), F.col("_mean").alias("median")),
    )
    long = rows.select(*s.key, s.time, target, "_sd", F.inline(models)).where(
        F.col("median").isNotNull() & F.col("_sd").isNotNull()
    )
    bounds = gaussian_bounds(F.col("median"), F.col("_sd"), clip=True)
    return long.select(*s.key, s.time, "model", target, "median", *[c.alias(n) for n, c in bounds.items()], F.col("_sd").alias("sd"))


def gaussian_from_interval(df: DataFrame, level: int = 80, width: float = 1.28) -> DataFrame:
    """Nine quantiles of the normal whose central interval is ``lower_L``/``upper_L``."""
    sd = (F.col(f"upper_{level}") - F.col(f"lower_{level}")) / F.lit(2.0 * width)
    return df.withColumns(gaussian_bounds(F.col("median"), sd))


def widen_intervals(df: DataFrame) -> DataFrame:
    """95 and 50 % bounds as multiples of the 80 % bounds. For positive values this puts
    ``lower_95`` above ``lower_80``; the submission checks report it."""
    return df.withColumns(
        {
            "lower_95": F.col("lower_80") * 1.1,
            "lower_50": F.col("lower_80") * 0.7,
            "upper_50": F.col("upper_80") * 0.7,
            "upper_95": F.col("upper_80") * 1.1,
        }
    )


def select_levels(df: DataFrame, levels: list[int], keep: tuple[str, ...] = ("uf", "date", "model")) -> DataFrame:
    bounds = [c for n in levels for c in (f"lower_{n}", f"upper_{n}")]
    return df.select(*keep, "median", *bounds)


def clip_intervals(df: DataFrame) -> DataFrame:
    """Median and lower bounds at least zero; upper bounds are left alone."""
    lows = [c for c in df.columns if c == "median" or c.startswith("lower_")]
    return df.withColumns({c: at_least(F.col(c)) for c in lows})


def quantile_long(df: DataFrame, keep: tuple[str, ...] = ("uf", "date", "model")) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(q).alias("quantile"), F.col(c).cast("double").alias("value"))
            for c, q in QUANTILE_COLUMNS.items()
            if c in df.columns
        ]
    )
    return df.select(*keep, F.inline(cells))


def reduce_samples(samples: DataFrame, by: tuple[str, ...] = ("uf", "date"), value: str = "value") -> DataFrame:
    """Mean, population deviation and nine quantiles of the samples of each row, however
    many samples a row has."""
    moments = samples.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return moments.join(group_quantiles(samples, list(by), value, QUANTILE_COLUMNS), list(by), "left")


def sequence_windows(
    df: DataFrame, features: list[str], target: str = "casos", length: int = 52, s: Series = Series()
) -> DataFrame:
    """The ``length`` feature rows before each row, oldest first, beside its target.
    Rows with a shorter past are left out, so short series yield nothing."""

    def build(w: Window) -> dict[str, Column]:
        row = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
        return {"sequence": F.collect_list(row).over(w.rowsBetween(-length, -1))}

    out = over_chunks(df, build, s, before=length)
    return out.where(F.size("sequence") == length).select(*s.key, s.time, "sequence", F.col(target).alias("y"))


def time_split(df: DataFrame, validation: float = 0.2, s: Series = Series()) -> DataFrame:
    """Add ``split``: the first ``floor(n·(1-validation))`` rows of each series train."""
    cut = F.floor(F.col("_n") * F.lit(1.0 - validation))
    role = F.when(F.col("_pos") <= cut, "train").otherwise("validation")
    return positions(df, s).withColumn("split", role).drop("_pos", "_n")


def cv_folds(df: DataFrame, n_splits: int = 5, gap: int = 4, s: Series = Series()) -> DataFrame:
    """Expanding-window folds: one copy of a row per fold it takes part in, with
    ``fold`` and ``role``. ``gap`` rows between train and test belong to neither."""
    size = F.floor(F.col("_n") / F.lit(n_splits + 1))
    index = F.col("_pos") - 1

    def part(i: int) -> Column:
        start = F.col("_n") - F.lit(n_splits - i) * size
        role = F.when(index < start - gap, "train").when((index >= start) & (index < start + size), "test")
        return F.when(role.isNotNull(), F.struct(F.lit(i).alias("fold"), role.alias("role")))

    tags = F.array_compact(F.array(*[part(i) for i in range(n_splits)]))
    return positions(df, s).select(*df.columns, F.inline(tags))


def cv_summary(fold_metrics: DataFrame, by: list[str], sample_std: bool = True) -> DataFrame:
    """Mean and deviation of fold scores; ``sample_std`` divides by ``n - 1``."""
    std = F.stddev_samp if sample_std else F.stddev_pop
    return fold_metrics.groupBy(*by).agg(
        F.avg("crps").alias("crps_mean"),
        std("crps").alias("crps_std"),
        F.avg("rmse").alias("rmse_mean"),
        F.avg("mae").alias("mae_mean"),
        F.avg("coverage_95").alias("coverage_95_mean"),
        F.count(F.lit(1)).alias("n_splits"),
    )


def softplus_normalize(df: DataFrame, target: str = "casos", s: Series = Series()) -> DataFrame:
    """Centre and scale each series, then ``log(1 + exp(x))``."""
    stats = df.groupBy(*s.key).agg(F.avg(target).alias("_c"), F.stddev_samp(target).alias("_s"))
    z = (F.col(target) - F.col("_c")) / (F.col("_s") + F.lit(1e-8))
    return attach(df, stats, list(s.key), [s.time]).withColumn(
        f"{target}_softplus", F.log1p(F.exp(z))
    ).drop("_c", "_s")
