"""From fine-grained observation tables to the series panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import ratio
from panelcast.operators.groups import attach, first_per_group

# Column names of the sources.
CLIMATE = [
    "temp_min", "temp_med", "temp_max",
    "precip_min", "precip_med", "precip_max", "precip_tot",
    "pressure_min", "pressure_med", "pressure_max",
    "rel_humid_min", "rel_humid_med", "rel_humid_max",
    "thermal_range", "rainy_days",
]
FLAGS = ["train_1", "train_2", "train_3", "target_1", "target_2", "target_3"]


def filter_panel(
    df: DataFrame,
    states: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    key: str = "uf",
    time: str = "date",
) -> DataFrame:
    """Keep the given states and dates (bounds inclusive); every argument is optional."""
    if states:
        df = df.where(F.col(key).isin(states))
    if start:
        df = df.where(F.col(time) >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col(time) <= F.lit(end).cast("date"))
    return df


def climate_columns(climate: DataFrame) -> DataFrame:
    """Keys plus the climate columns present."""
    return climate.select("date", "epiweek", "geocode", *[c for c in CLIMATE if c in climate.columns])


def _one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; the smallest by the remaining columns, so that reruns agree."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    return first_per_group(df, keys, rest or [F.col(keys[0])])


def join_climate(df: DataFrame, climate: DataFrame) -> DataFrame:
    unique = _one_per_key(climate_columns(climate), ["date", "geocode"])
    return df.join(unique, ["date", "geocode", "epiweek"], "left")


def join_population(df: DataFrame, population: DataFrame, carry_forward: bool = False) -> DataFrame:
    """Population of the row's calendar year, or with ``carry_forward`` of the latest
    earlier year on record."""
    unique = _one_per_key(population.select("geocode", "year", "population"), ["geocode", "year"])
    rows = df.withColumn("year", F.year("date"))
    if not carry_forward:
        return attach(rows, unique, ["geocode", "year"], ["date"])
    # one short array of (year, population) per place, at most one entry per calendar year
    history = unique.groupBy("geocode").agg(
        F.sort_array(F.collect_list(F.struct("year", "population")), asc=False).alias("_h")
    )
    known = F.filter("_h", lambda p: p["year"] <= F.col("year"))
    return (
        attach(rows, history, ["geocode"], ["date"])
        .withColumn("population", F.try_element_at(known, F.lit(1))["population"])
        .drop("_h")
    )


def join_environ(df: DataFrame, environ: DataFrame) -> DataFrame:
    unique = _one_per_key(environ.select("geocode", "koppen", "biome"), ["geocode"])
    return attach(df, unique, ["geocode"], ["date"])


def merge_sources(
    dengue: DataFrame,
    climate: DataFrame | None = None,
    population: DataFrame | None = None,
    environ: DataFrame | None = None,
    states: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    carry_population: bool = False,
) -> DataFrame:
    """Observations with climate, population and environment; absent tables are skipped."""
    df = filter_panel(dengue, states, start, end)
    if climate is not None:
        df = join_climate(df, climate)
    if population is not None:
        df = join_population(df, population, carry_population)
    if environ is not None:
        df = join_environ(df, environ)
    return df


def aggregate_to_state(df: DataFrame) -> DataFrame:
    """Roll municipalities up to one row per state and week.

    The aggregation combines map-side, so a state holding most rows sends one partial
    row per task and week. Rows without state or date are dropped.
    """
    have = set(df.columns)
    keys = [c for c in ["date", "uf", "epiweek"] if c in have]
    aggregates: list[Column] = [F.sum("casos").alias("casos")]
    aggregates += [F.avg(c).alias(c) for c in CLIMATE if c in have]
    if "population" in have:
        aggregates.append(F.sum("population").alias("population"))
    aggregates += [F.bool_or(c).alias(c) for c in FLAGS if c in have]
    out = df.dropna(subset=keys).groupBy(*keys).agg(*aggregates)
    if "population" in have:
        out = out.withColumn("incidence_rate", ratio(F.col("casos"), F.col("population")) * 100000.0)
    return out


def available_states(df: DataFrame, key: str = "uf") -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def date_range(df: DataFrame, time: str = "date") -> DataFrame:
    def text(c: Column) -> Column:
        return F.date_format(c, "yyyy-MM-dd")

    return df.agg(text(F.min(time)).alias("min_date"), text(F.max(time)).alias("max_date"))


def state_from_geocode(df: DataFrame, codes: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``state`` from the first two digits of ``geocode``; unknown codes give NULL,
    or an error with ``strict``."""
    rows = df.withColumn("_code", F.substring(F.col("geocode").cast("string"), 1, 2).cast("int"))
    named = codes.select(F.col("code").alias("_code"), F.col("uf").alias("state"))
    spread = ["date"] if "date" in df.columns else ["geocode"]
    out = attach(rows, named, ["_code"], spread).drop("_code")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown state code of "), F.col("geocode").cast("string")))
        out = out.withColumn("state", F.coalesce("state", unknown.cast("string")))
    return out


def ocean_range(ocean: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return filter_panel(ocean, None, start, end).orderBy("date")


def flag_split(df: DataFrame, role: str, test: int = 3) -> DataFrame:
    """Rows whose ``train_<test>`` or ``target_<test>`` flag is set."""
    column = f"{role}_{test}"
    missing = [c for c in (f"train_{test}", f"target_{test}") if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.where(F.col(column))


def profile(df: DataFrame, time: str = "date") -> DataFrame:
    """Rows, date range and the share of missing values of every column, in one pass."""
    columns = [c for c in df.columns if c != time]
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(time).alias("min_date"),
        F.max(time).alias("max_date"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in columns],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), (F.col(f"m_{c}") * 100).alias("missing_pct")) for c in columns]
    )
    return one.select("n_rows", "min_date", "max_date", F.inline(pairs))
