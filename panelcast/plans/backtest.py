"""Rolling-season backtests: one job over all series, models and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.reference import BACKTEST_SEASONS
from panelcast.operators.forecasts import gaussian_bounds
from panelcast.operators.groups import top_per_group
from panelcast.operators.scores import ALL_LEVELS, evaluate
from panelcast.operators.seasons import assign_seasons
from panelcast.series import Series
from panelcast.session import cut_lineage


def score_tests(
    forecasts: DataFrame,
    seasons: list[tuple] = BACKTEST_SEASONS,
    truth: str = "casos",
    levels: list[int] = ALL_LEVELS,
    s: Series = Series(),
) -> DataFrame:
    """Scores per series, test and model over each test's target window."""
    tagged = assign_seasons(forecasts, seasons, s.time).where(F.col("role") == "target")
    return evaluate(tagged, [*s.key, "test", "model"], truth, levels)


def season_forecasts(
    panel: DataFrame,
    seasons: list[tuple] = BACKTEST_SEASONS,
    target: str = "casos",
    window: int = 12,
    season_days: int = 364,
    s: Series = Series(),
) -> DataFrame:
    """Baseline forecasts of every week of each test's target window, made at the end of its training data.

    Only rows up to ``train_end`` are used, and the window is a calendar, whether or not its weeks have
    been observed. ``naive`` carries the last value, ``mean<window>`` the mean of the last ``window``
    rows, ``seasonal`` the latest value of the same week of the season. The spread is the deviation of
    the last ``window`` rows times the root of one plus the horizon in seasons.
    """
    keys = [*s.key, "test"]
    windows = {test: (F.lit(end).cast("date"), F.lit(a).cast("date"), F.lit(b).cast("date")) for test, _, end, a, b in seasons}

    def of_test(i: int) -> Column:
        value = F.lit(None).cast("date")
        for test, dates in windows.items():
            value = F.when(F.col("test") == test, dates[i]).otherwise(value)
        return value

    known = assign_seasons(panel.select(*s.key, s.time, target), seasons, s.time).where(F.col("role") == "train")
    known = known.where(F.col(target).isNotNull()).select(*keys, F.col(s.time).alias("_t"), F.col(target).cast("double").alias("_y"))
    origin = top_per_group(known, keys, [F.col("_t").desc()], window, "_rank").groupBy(*keys).agg(
        F.max_by("_y", "_t").alias("_last"), F.avg("_y").alias("_mean"), F.stddev_samp("_y").alias("_sd")
    )
    weeks = origin.withColumn(s.time, F.explode(F.sequence(of_test(1), of_test(2), F.expr("interval 7 days"))))
    days = F.datediff(F.col(s.time), of_test(0))
    weeks = weeks.withColumn("_t", F.date_sub(s.time, (F.ceil(days / season_days) * season_days).cast("int")))
    recent = known.where(F.col("_t") > F.date_sub(of_test(0), season_days))
    rows = weeks.join(recent, [*keys, "_t"], "left").withColumn("sd", F.col("_sd") * F.sqrt(1 + days / F.lit(float(season_days))))
    models = [("naive", "_last"), ("seasonal", "_y"), (f"mean{window}", "_mean")]
    long = rows.select(*keys, s.time, "sd", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("median")) for m, c in models])))
    long = long.where(F.col("median").isNotNull() & F.col("sd").isNotNull())
    bounds = gaussian_bounds(F.col("median"), F.col("sd"), clip=True)
    return long.select(*keys, "model", s.time, "median", *[c.alias(n) for n, c in bounds.items()])


def score_seasons(
    forecasts: DataFrame, panel: DataFrame, truth: str = "casos", levels: list[int] = ALL_LEVELS, s: Series = Series()
) -> DataFrame:
    """Scores per series, test and model over the weeks of each window that have been observed."""
    seen = forecasts.join(panel.select(*s.key, s.time, truth).where(F.col(truth).isNotNull()), [*s.key, s.time])
    return evaluate(seen, [*s.key, "test", "model"], truth, levels)


def backtest_baselines(
    panel: DataFrame, seasons: list[tuple] = BACKTEST_SEASONS, target: str = "casos", s: Series = Series()
) -> DataFrame:
    """Scores of the baseline models, each forecast made at the end of its test's training data.
    The panel is written first, since it is read for the origins and for the truth."""
    panel = cut_lineage(panel)
    return score_seasons(season_forecasts(panel, seasons, target, s=s), panel, target, s=s)


def train_test_counts(panel: DataFrame, seasons: list[tuple] = BACKTEST_SEASONS, s: Series = Series()) -> DataFrame:
    """Rows each series contributes to each test, by role."""
    return assign_seasons(panel, seasons, s.time).groupBy(*s.key, "test").agg(
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "target").alias("n_target"),
    )
