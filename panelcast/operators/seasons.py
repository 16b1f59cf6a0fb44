"""Backtest windows: which rows train and which are scored in each test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.reference import BACKTEST_SEASONS


def _window(test: str, season: str, train_end: str, start: str, end: str, time: str) -> Column:
    """The row's membership in one test: NULL when it plays no part in it."""
    date = F.col(time)
    role = F.when(date <= F.lit(train_end).cast("date"), "train").when(
        date.between(F.lit(start).cast("date"), F.lit(end).cast("date")), "target"
    )
    return F.when(
        role.isNotNull(),
        F.struct(F.lit(test).alias("test"), F.lit(season).alias("season"), role.alias("role")),
    )


def assign_seasons(df: DataFrame, seasons: list[tuple] = BACKTEST_SEASONS, time: str = "date") -> DataFrame:
    """One copy of each row per test it takes part in, with ``test, season, role``.

    The handful of windows is part of the expression, so there is no join and no
    shuffle: a row is tested against each window where it is read. Windows may overlap.
    """
    if not seasons:
        raise ValueError("no seasons given")
    tags = F.array_compact(F.array(*[_window(*s, time=time) for s in seasons]))
    return df.select("*", F.inline(tags))


def train_rows(df: DataFrame, train_end: str, time: str = "date") -> DataFrame:
    return df.where(F.col(time) <= F.lit(train_end).cast("date"))


def plot_window(df: DataFrame, train_end: str, last_forecast: str, time: str = "date") -> DataFrame:
    """Rows from a year before the end of training to 30 days past the last forecast,
    tagged ``training`` or ``prediction``."""
    end = F.lit(train_end).cast("date")
    return df.where(
        F.col(time).between(F.date_sub(end, 365), F.date_add(F.lit(last_forecast).cast("date"), 30))
    ).withColumn("phase", F.when(F.col(time) <= end, "training").otherwise("prediction"))
