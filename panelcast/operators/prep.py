"""Cleaning, imputation, normalization and calendar completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import at_least, ratio, week_of_epiweek
from panelcast.operators.groups import attach, column_quantiles, first_per_group
from panelcast.series import Series, nearest_in_series, positions
from panelcast.session import cut_lineage

EPSILON = 1e-8
NOT_IMPUTED = ["epiweek", "year"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def dedup_keep_last(df: DataFrame, order: str, s: Series = Series()) -> DataFrame:
    """One row per series and date: the last by ``order``, ties by the other columns."""
    keys = [*s.key, s.time]
    rest = [F.col(c).desc_nulls_last() for c in df.columns if c not in keys and c != order]
    return first_per_group(df, keys, [F.col(order).desc_nulls_last(), *rest])


def carry_columns(df: DataFrame, columns: list[str], s: Series = Series()) -> DataFrame:
    """Forward fill, then backward fill."""
    found = nearest_in_series(df, columns, s)
    fills = {c: F.coalesce(F.col(f"_before_{c}.x"), F.col(f"_after_{c}.x")) for c in columns}
    return found.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in df.columns])


def interpolate_columns(
    df: DataFrame, columns: list[str], s: Series = Series(), max_gap: int | None = None
) -> DataFrame:
    """Linear interpolation by row position. Leading gaps stay NULL, trailing gaps repeat
    the last value; with ``max_gap`` longer gaps stay NULL."""
    found = nearest_in_series(positions(df, s), columns, s, at="_pos")

    def line(c: str) -> Column:
        left, right = F.col(f"_before_{c}"), F.col(f"_after_{c}")
        span = right["at"] - left["at"]
        slope = ratio(right["x"] - left["x"], span)
        inner = left["x"] + slope * (F.col("_pos") - left["at"])
        value = (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(right.isNull(), left["x"].cast("double"))
            .otherwise(inner)
        )
        if max_gap is None:
            return value
        missing = F.coalesce(right["at"], F.col("_n") + 1) - left["at"] - 1
        return F.when(F.col(c).isNotNull() | (missing <= max_gap), value)

    return found.select(*[line(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def outlier_bounds(
    df: DataFrame,
    columns: list[str],
    method: str = "iqr",
    k: float = 3.0,
    keys: list[str] | None = None,
) -> DataFrame:
    """``lower_<c>`` and ``upper_<c>`` per group."""
    keys = ["uf"] if keys is None else keys
    made = []
    if method == "iqr":
        stats = column_quantiles(df, keys, columns, {"q1": 0.25, "q3": 0.75})
        for c in columns:
            width = F.col(f"q3_{c}") - F.col(f"q1_{c}")
            made += [(F.col(f"q1_{c}") - k * width).alias(f"lower_{c}"), (F.col(f"q3_{c}") + k * width).alias(f"upper_{c}")]
    elif method == "zscore":
        stats = df.groupBy(*keys).agg(
            *[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]
        )
        for c in columns:
            m, s = F.col(f"m_{c}"), F.col(f"s_{c}")
            made += [(m - k * s).alias(f"lower_{c}"), (m + k * s).alias(f"upper_{c}")]
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return stats.select(*keys, *made)


def handle_outliers(
    df: DataFrame,
    columns: list[str],
    treatment: str = "cap",
    method: str = "iqr",
    k: float = 3.0,
    s: Series = Series(),
) -> DataFrame:
    """Cap outliers, set them to NULL (``nan``), or remove their rows."""
    if treatment not in ("cap", "nan", "remove"):
        raise ValueError(f"unknown treatment: {treatment}")
    keys = list(s.key)
    rows = attach(df, outlier_bounds(df, columns, method, k, keys), keys, [s.time])
    new: dict[str, Column] = {}
    outlying = F.lit(False)
    for c in columns:
        x, low, high = F.col(c), F.col(f"lower_{c}"), F.col(f"upper_{c}")
        outside = F.coalesce((x < low) | (x > high), F.lit(False))
        outlying = outlying | outside
        if treatment == "cap":
            new[c] = F.when(x < low, low).when(x > high, high).otherwise(x.cast("double"))
        elif treatment == "nan":
            new[c] = F.when(~outside, x)
    if treatment == "remove":
        rows = rows.where(~outlying)
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def repair_types(df: DataFrame) -> DataFrame:
    """Cast dirty input: dates, integer weeks, non-negative whole case counts."""
    have = set(df.columns)
    fixes = {}
    if "date" in have:
        fixes["date"] = F.col("date").try_cast("date")
    if "epiweek" in have:
        fixes["epiweek"] = F.col("epiweek").try_cast("int")
    if "casos" in have:
        fixes["casos"] = F.coalesce(at_least(F.col("casos").try_cast("double")), F.lit(0.0)).cast("bigint")
    return df.withColumns(fixes)


def clean(
    df: DataFrame,
    order: str | None = None,
    outliers: bool = True,
    method: str = "iqr",
    k: float = 3.0,
    s: Series = Series(),
) -> DataFrame:
    """Deduplicate, repair types, fill population along the series, cap outliers."""
    if order is not None:
        df = dedup_keep_last(df, order, s)
    df = repair_types(df)
    if "population" in df.columns:
        df = carry_columns(df, ["population"], s)
    if outliers:
        present = [c for c in ("casos", "incidence_rate") if c in df.columns]
        # the bounds look at the rows twice more: what was done so far is written once
        df = handle_outliers(cut_lineage(df), present, "cap", method, k, s)
    return df


def impute_seasonal(
    df: DataFrame, columns: list[str], s: Series = Series(), by: str = "week"
) -> DataFrame:
    """Fill with the median of the same week of the year, then of the whole series.

    ``by="epiweek"`` groups by the raw year-week number instead.
    """
    keys = list(s.key)
    if "epiweek" in df.columns:
        week = week_of_epiweek(F.col("epiweek")) if by == "week" else F.col("epiweek")
    else:
        week = F.weekofyear(s.time)
    rows = df.withColumn("_week", week)
    # a series has one row per week and year, so these groups are as long as its years
    weekly = rows.groupBy(*keys, "_week").agg(
        *[F.median(c).alias(f"_w_{c}") for c in columns]
    )
    whole = column_quantiles(rows, keys, columns, {"_g": 0.5})
    rows = attach(attach(rows, weekly, [*keys, "_week"], [s.time]), whole, keys, [s.time])
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_w_{c}"), F.col(f"_g_{c}")) for c in columns}
    return rows.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def fill_with_median(df: DataFrame, columns: list[str], s: Series = Series()) -> DataFrame:
    middle = column_quantiles(df, list(s.key), columns, {"_g": 0.5})
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_g_{c}")) for c in columns}
    return attach(df, middle, list(s.key), [s.time]).select(
        *[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
    )


def impute(
    df: DataFrame,
    method: str = "seasonal",
    columns: list[str] | None = None,
    s: Series = Series(),
    max_gap: int | None = None,
) -> DataFrame:
    """Impute numeric columns: ``seasonal``, ``linear``, ``forward`` or ``spline``."""
    if columns is None:
        columns = [c for c in numeric_columns(df) if c not in NOT_IMPUTED and c not in s.key]
    if method == "seasonal":
        return impute_seasonal(df, columns, s)
    if method == "linear":
        return fill_with_median(cut_lineage(interpolate_columns(df, columns, s, max_gap)), columns, s)
    if method == "forward":
        return carry_columns(df, columns, s)
    if method == "spline":
        from panelcast.operators.spline import spline_columns

        return fill_with_median(spline_columns(df, columns, s), columns, s)
    raise ValueError(f"unknown imputation method: {method}")


def epi_features(df: DataFrame) -> DataFrame:
    """Incidence per 100 000, its log, log cases and the week of the year."""
    have = set(df.columns)
    if {"casos", "population"} <= have:
        df = df.withColumn("incidence_rate", ratio(F.col("casos"), F.col("population")) * 100000.0)
    if "incidence_rate" in df.columns:
        df = df.withColumn("log_incidence", F.log1p("incidence_rate"))
    if "casos" in have:
        df = df.withColumn("log_cases", F.log1p(F.col("casos").cast("double")))
    if "epiweek" in have:
        df = df.withColumn("week_of_year", week_of_epiweek(F.col("epiweek")))
    return df


def normalize(
    df: DataFrame, columns: list[str], method: str = "standard", s: Series = Series()
) -> DataFrame:
    """Scale columns within each series: ``standard``, ``minmax`` or ``robust``."""
    keys = list(s.key)
    if method in ("standard", "minmax"):
        parts = []
        for c in columns:
            if method == "standard":
                parts += [F.avg(c).alias(f"_a_{c}"), F.stddev_samp(c).alias(f"_b_{c}")]
            else:
                parts += [F.min(c).cast("double").alias(f"_a_{c}"), (F.max(c) - F.min(c)).alias(f"_b_{c}")]
        rows = attach(df, df.groupBy(*keys).agg(*parts), keys, [s.time])
    elif method == "robust":
        q = column_quantiles(df, keys, columns, {"_a": 0.5, "_q1": 0.25, "_q3": 0.75})
        q = q.withColumns({f"_b_{c}": F.col(f"_q3_{c}") - F.col(f"_q1_{c}") for c in columns})
        rows = attach(df, q, keys, [s.time])
    else:
        raise ValueError(f"unknown method: {method}")
    scaled = {c: (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") + F.lit(EPSILON)) for c in columns}
    return rows.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def fill_date_gaps(
    df: DataFrame, s: Series = Series(), step_days: int = 7, constants: list[str] | None = None
) -> DataFrame:
    """Complete every series so that each of its weeks has a row.

    Weeks are counted from the series' own first date. Every row stays, with its own date, also
    where it does not fall on the calendar or shares its week with others; a row is added, at the
    week's first day, for each week up to the last date that has none. Added rows are NULL except
    for the keys, the ``constants``, which take the series' first value, and ``epiweek``, which
    follows from the date. The calendar is generated from the two end dates where it is used; it
    never exists in one place. Rows without key or date belong to no series and are left out.
    """
    keys, constants = list(s.key), constants or []
    df = df.dropna(subset=[*keys, s.time])
    ends = df.groupBy(*keys).agg(
        F.min(s.time).alias("_from"),
        F.max(s.time).alias("_to"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(s.time))).alias(f"_first_{c}") for c in constants],
    )
    # years first, then weeks of a year, so that long calendars spread over tasks
    calendar = (
        ends.withColumn("_w0", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("_to", "_from") / step_days), F.lit(52))))
        .withColumn("_w", F.explode(F.sequence(F.col("_w0"), F.col("_w0") + 51)))
        .withColumn("_week", F.date_add("_from", (F.col("_w") * step_days).cast("int")))
        .where(F.col("_week") <= F.col("_to"))
    )
    dated = attach(df, ends, keys, [s.time])
    week = F.date_add("_from", (F.floor(F.datediff(s.time, "_from") / step_days) * step_days).cast("int"))
    taken = dated.select(*keys, week.alias("_week")).distinct()
    types = {f.name: f.dataType for f in df.schema.fields}
    made = {**{k: F.col(k) for k in keys}, s.time: F.col("_week").cast(types[s.time]), **{c: F.col(f"_first_{c}") for c in constants}}
    if "epiweek" in types and "epiweek" not in made:
        made["epiweek"] = (F.year("_week") * 100 + F.weekofyear("_week")).cast(types["epiweek"])
    added = calendar.join(taken, [*keys, "_week"], "left_anti").select(
        *[made.get(c, F.lit(None).cast(types[c])).alias(c) for c in df.columns]
    )
    kept = dated.select(*[F.coalesce(F.col(c), F.col(f"_first_{c}")).alias(c) if c in constants else F.col(c) for c in df.columns])
    return kept.unionByName(added)


def last_dates(df: DataFrame, s: Series = Series()) -> DataFrame:
    return df.groupBy(*s.key).agg(F.max(s.time).alias("last_date"))


def future_dates(df: DataFrame, n_weeks: int, s: Series = Series()) -> DataFrame:
    """The ``n_weeks`` weekly dates after each series' last date."""
    return last_dates(df, s).select(
        *s.key,
        F.explode(F.sequence(F.lit(1), F.lit(n_weeks))).alias("step"),
        F.date_add("last_date", F.col("step") * 7).alias(s.time),
    )
