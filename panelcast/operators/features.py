"""Calendar, lag, rolling, climate, spatial and ocean features.

The window features come as frame builders (``lag_exprs`` and so on) so that several of
them can share one chunked pass; each also has a DataFrame form of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import PEAK_MONTHS, cycle, heat_index, ratio, season
from panelcast.operators.groups import attach
from panelcast.series import Series, over_chunks

# Default feature parameters, in weeks.
LAGS = [1, 2, 3, 4, 8, 12, 16, 20, 24, 52]
WINDOWS = [2, 4, 8, 12, 24]
STATS = ["mean", "std", "min", "max"]
DIFF_PERIODS = [1, 4, 52]
HORIZON = 4
OCEAN = ["enso", "iod", "pdo"]


def time_features(df: DataFrame, time: str = "date") -> DataFrame:
    month = F.month(time)
    week_sin, week_cos = cycle(F.weekofyear(time), 52)
    month_sin, month_cos = cycle(month, 12)
    return df.withColumns(
        {
            "week_of_year": F.weekofyear(time),
            "month": month,
            "year": F.year(time),
            "day_of_year": F.dayofyear(time),
            "quarter": F.quarter(time),
            "week_sin": week_sin,
            "week_cos": week_cos,
            "month_sin": month_sin,
            "month_cos": month_cos,
            "season": season(month),
            "is_dengue_season": month.isin(PEAK_MONTHS).cast("int"),
        }
    )


def lag_exprs(w: Window, target: str, lags: list[int]) -> dict[str, Column]:
    return {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}


def _middle(values: Column) -> Column:
    """Median of an array, NULL when empty."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(ordered, low) + F.element_at(ordered, high)) / F.lit(2.0))


def rolling_exprs(w: Window, target: str, windows: list[int], stats: list[str]) -> dict[str, Column]:
    """Statistics over the ``n`` rows before the current one."""
    y = F.col(target).cast("double")
    out = {}
    for n in windows:
        past = w.rowsBetween(-n, -1)
        made = {
            "mean": lambda: F.avg(y).over(past),
            "std": lambda: F.stddev_samp(y).over(past),
            "min": lambda: F.min(target).over(past),
            "max": lambda: F.max(target).over(past),
            "median": lambda: _middle(F.collect_list(y).over(past)),
        }
        for stat in stats:
            out[f"{target}_roll_{stat}_{n}"] = made[stat]()
    return out


def diff_exprs(w: Window, target: str, periods: list[int]) -> dict[str, Column]:
    out = {}
    for p in periods:
        past = F.lag(target, p).over(w)
        out[f"{target}_diff_{p}"] = F.col(target) - past
        out[f"{target}_pct_change_{p}"] = ratio(F.col(target) - past, past)
    return out


def horizon_exprs(w: Window, target: str, horizon: int) -> dict[str, Column]:
    return {f"{target}_horizon_{h}": F.lead(target, h).over(w) for h in range(1, horizon + 1)}


def lag_features(df: DataFrame, target: str = "casos", lags: list[int] = LAGS, s: Series = Series()) -> DataFrame:
    return over_chunks(df, lambda w: lag_exprs(w, target, lags), s, before=max(lags))


def rolling_features(
    df: DataFrame,
    target: str = "casos",
    windows: list[int] = WINDOWS,
    stats: list[str] = STATS,
    s: Series = Series(),
) -> DataFrame:
    return over_chunks(df, lambda w: rolling_exprs(w, target, windows, stats), s, before=max(windows))


def diff_features(
    df: DataFrame, target: str = "casos", periods: list[int] = DIFF_PERIODS, s: Series = Series()
) -> DataFrame:
    return over_chunks(df, lambda w: diff_exprs(w, target, periods), s, before=max(periods))


def horizon_targets(
    df: DataFrame, target: str = "casos", horizon: int = HORIZON, s: Series = Series()
) -> DataFrame:
    return over_chunks(df, lambda w: horizon_exprs(w, target, horizon), s, after=horizon)


def climate_features(df: DataFrame) -> DataFrame:
    """Heat index and interactions, each where its inputs are present."""
    have = set(df.columns)
    made: dict[str, Column] = {}
    if {"temp_med", "rel_humid_med"} <= have:
        made["heat_index"] = heat_index(F.col("temp_med"), F.col("rel_humid_med"))
    if {"temp_max", "temp_min"} <= have:
        made["temp_range"] = F.col("temp_max") - F.col("temp_min")
    if {"temp_med", "precip_tot"} <= have:
        made["temp_precip_interaction"] = F.col("temp_med") * F.col("precip_tot")
    if {"rel_humid_med", "precip_tot"} <= have:
        made["humidity_precip_interaction"] = F.col("rel_humid_med") * F.col("precip_tot")
    if "temp_med" in have:
        made["temp_squared"] = F.col("temp_med") * F.col("temp_med")
    return df.withColumns(made) if made else df


def spatial_means(df: DataFrame, edges: DataFrame, target: str = "casos", s: Series = Series()) -> DataFrame:
    """Mean of the neighbours' target per series and date, where any neighbour reports.

    Each value is sent to the series that list its own as a neighbour; the means combine
    map-side.
    """
    (key,) = s.key
    values = df.select(F.col(key).alias("neighbor"), s.time, F.col(target).alias("_y"))
    # edges are joined as rows, so a hub with very many neighbours is never one list; a side that is
    # large for one series is split by Spark's handling of skewed joins
    spread = edges.select("neighbor", F.col("uf").alias(key)).distinct()
    return (
        values.join(spread, "neighbor")
        .groupBy(key, s.time)
        .agg(F.avg("_y").alias(f"{target}_spatial_lag"))
    )


def spatial_lag(df: DataFrame, edges: DataFrame, target: str = "casos", s: Series = Series()) -> DataFrame:
    """Mean of the neighbours' target on the same date; NULL where no neighbour reports."""
    return df.join(spatial_means(df, edges, target, s), [*s.key, s.time], "left")


def ocean_exact(df: DataFrame, ocean: DataFrame, lags: tuple[int, ...] = (4, 8), s: Series = Series()) -> DataFrame:
    """Ocean indices of the same date and their values 4 and 8 rows earlier."""
    have = [c for c in OCEAN if c in ocean.columns]
    joined = attach(df, ocean.select(s.time, *have), [s.time], list(s.key))

    def build(w: Window) -> dict[str, Column]:
        return {f"{c}_lag{k}": F.lag(c, k).over(w) for k in lags for c in have}

    return over_chunks(joined, build, s, before=max(lags))


def ocean_lookup(
    dates: DataFrame, ocean: DataFrame, lag_weeks: tuple[int, ...] = (0, 4, 8, 12), time: str = "date"
) -> DataFrame:
    """Per distinct date the latest ocean row at or before it, and at or before the dates
    4, 8 and 12 weeks back.

    There is at most one date per calendar day, so ordering them is small work whatever
    the size of the panel.
    """
    have = [c for c in OCEAN if c in ocean.columns]
    lags = F.explode(F.array(*[F.lit(k) for k in lag_weeks]))
    probes = dates.select(lags.alias("_k"), F.col(time).alias("_for"), time)
    wanted = probes.select(
        "_k", "_for", F.date_sub(time, F.col("_k") * 7).alias("_at"), F.lit(1).alias("_side"),
        F.lit(None).cast(T.StructType([T.StructField(c, T.DoubleType()) for c in have])).alias("_v"),
    )
    known = ocean.select(
        lags.alias("_k"), F.lit(None).cast("date").alias("_for"), F.col(time).alias("_at"),
        F.lit(0).alias("_side"), F.struct(*[F.col(c).cast("double").alias(c) for c in have]).alias("_v"),
    )
    so_far = Window.partitionBy("_k").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        known.unionByName(wanted)
        .withColumn("_v", F.last("_v", ignorenulls=True).over(so_far))
        .where(F.col("_side") == 1)
    )

    def name(c: str, k: int) -> str:
        return c if k == 0 else f"{c}_lag{k}"

    return found.groupBy(F.col("_for").alias(time)).agg(
        *[F.max(F.when(F.col("_k") == k, F.col(f"_v.{c}"))).alias(name(c, k)) for k in lag_weeks for c in have]
    )


def ocean_asof(
    df: DataFrame, ocean: DataFrame, lag_weeks: tuple[int, ...] = (0, 4, 8, 12), s: Series = Series()
) -> DataFrame:
    """Add the latest ocean row at or before each row's date, and before its lags."""
    found = ocean_lookup(df.select(s.time).distinct(), ocean, lag_weeks, s.time)
    return attach(df, found, [s.time], list(s.key))


# Columns that never serve as features.
NOT_FEATURES = [
    "date", "uf", "geocode", "epiweek", "year",
    "train_1", "train_2", "train_3", "target_1", "target_2", "target_3",
    "regional_geocode", "macroregional_geocode",
]


def feature_names(df: DataFrame, target: str = "casos", exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns usable as features; every horizon target is left out."""
    banned = {*NOT_FEATURES, target, *exclude}
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
        and f.name not in banned
        and not f.name.startswith(f"{target}_horizon_")
    ]


def forecast_features(df: DataFrame, target: str = "casos", exclude: tuple[str, ...] = ()) -> list[str]:
    """:func:`feature_names` without columns made of the row's own target or of its neighbours' at the same
    time: differences, relative changes and neighbour means. None of them is known when a forecast is made."""
    own = (f"{target}_diff_", f"{target}_pct_change_", f"{target}_spatial", f"log_{target}", "incidence_rate", "log_incidence", "log_cases")
    return [c for c in feature_names(df, target, exclude) if not c.startswith(own)]


def select_features(
    df: DataFrame, target: str = "casos", exclude: tuple[str, ...] = (), s: Series = Series()
) -> DataFrame:
    return df.select(*s.key, s.time, target, *feature_names(df, target, exclude))


def covariate_roles(df: DataFrame, target: str = "casos", s: Series = Series(), most: int | None = None) -> dict[str, list[str]]:
    """Split numeric columns into inputs known ahead of time and inputs only observed, the first ``most``
    of the latter if it is given."""
    names = df.columns
    known = ["time_idx"] + [c for c in ("epiweek", "year") if c in names]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    others = [c for c in numeric if c not in {target, s.time, "time_idx", *s.key}]
    return {"known": known, "unknown": [target, *[c for c in others[:most] if c != target]]}


def time_index(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Whole weeks since the series' first date."""
    first = df.groupBy(*s.key).agg(F.min(s.time).alias("_first"))
    weeks = F.floor(F.datediff(s.time, "_first") / F.lit(7)).cast("int")
    return attach(df, first, list(s.key), [s.time]).withColumn("time_idx", weeks).drop("_first")


def encoder_rows(df: DataFrame, prediction_length: int, s: Series = Series()) -> DataFrame:
    """Rows up to ``prediction_length`` weeks before the series' end, with ``time_idx``."""
    ends = df.groupBy(*s.key).agg(F.min(s.time).alias("_first"), F.max(s.time).alias("_last"))

    def weeks(c: str) -> Column:
        return F.floor(F.datediff(c, "_first") / F.lit(7)).cast("int")

    return (
        attach(df, ends, list(s.key), [s.time])
        .withColumn("time_idx", weeks(s.time))
        .where(F.col("time_idx") <= weeks("_last") - prediction_length)
        .drop("_first", "_last")
    )
