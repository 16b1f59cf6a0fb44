"""Submission documents: shaping, flattening and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import at_least
from panelcast.operators.scores import ALL_LEVELS, levels_of

REQUIRED = ("date", "median")


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def _values(df: DataFrame) -> list[str]:
    return ["median"] + [c for n in levels_of(df, ALL_LEVELS) for c in (f"lower_{n}", f"upper_{n}")]


def format_forecasts(
    df: DataFrame,
    by: tuple[str, ...] = ("uf",),
    model_id: int | None = None,
    predict_date: str | None = None,
    description: str = "",
    commit: str | None = None,
    adm_0: str = "BRA",
) -> DataFrame:
    """One document per group: parallel arrays in date order, values clipped at zero.

    A document is one forecast of one series, so its arrays hold its horizon.
    """
    require_columns(df)
    columns = _values(df)
    row = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"), *[at_least(F.col(c).cast("double")).alias(c) for c in columns]
    )
    grouped = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    arrays = [F.col("_r.date").alias("dates"), F.col("_r.median").alias("preds")]
    arrays += [F.col(f"_r.{c}").alias(c) for c in columns if c != "median"]
    adm_1 = F.col("uf") if "uf" in by else F.lit(None).cast("string")
    fallback = F.concat(F.lit("Forecast for "), F.col("uf")) if "uf" in by else F.lit("National forecast for Brazil")
    return grouped.select(
        F.lit(model_id).cast("int").alias("model"),
        (F.lit(description) if description else fallback).alias("description"),
        F.lit(commit).cast("string").alias("commit"),
        (F.lit(predict_date) if predict_date else F.date_format(F.current_date(), "yyyy-MM-dd")).alias("predict_date"),
        F.lit(adm_0).alias("adm_0"),
        adm_1.alias("adm_1"),
        F.lit(None).cast("int").alias("adm_2"),
        F.lit(None).cast("int").alias("adm_3"),
        F.struct(*arrays).alias("prediction"),
    )


def national_total(df: DataFrame) -> DataFrame:
    """Sum of the states' forecasts per date."""
    return df.groupBy("date").agg(*[F.sum(c).alias(c) for c in _values(df)])


def format_all(df: DataFrame, national: DataFrame | None = None, **meta) -> DataFrame:
    """Every state's document, and the national one if its forecast is given."""
    out = format_forecasts(df, ("uf",), **meta)
    if national is not None:
        out = out.unionByName(format_forecasts(national, (), **meta))
    return out


def _arrays(documents: DataFrame) -> list[str]:
    return documents.schema["prediction"].dataType.fieldNames()


def to_rows(documents: DataFrame) -> DataFrame:
    """Back to one row per date; the national document shows as ``BR``."""
    names = _arrays(documents)
    zipped = F.arrays_zip(*[F.col(f"prediction.{n}").alias(n) for n in names])
    flat = documents.select("adm_0", F.coalesce("adm_1", F.lit("BR")).alias("adm_1"), F.inline(zipped))
    return flat.select(F.col("dates").alias("date"), "adm_0", "adm_1", F.col("preds").alias("median"), *[n for n in names if n not in ("dates", "preds")])


def validate_documents(documents: DataFrame) -> DataFrame:
    """Issues ``(adm_1, issue, index)``: empty or unequal arrays, negative lower bounds,
    crossing bounds at a position."""
    names = _arrays(documents)
    p = lambda n: F.col(f"prediction.{n}")
    size = lambda n: F.coalesce(F.size(p(n)), F.lit(0))
    nowhere = F.lit(None).cast("int").alias("index")

    def issue(condition: Column, text: str) -> Column:
        return F.array_compact(F.array(F.when(condition, F.struct(F.lit(text).alias("issue"), nowhere))))

    def crossing(text: str):
        def at(v: Column, i: Column) -> Column:
            return F.when(v["l"] > v["h"], F.struct(F.lit(text).alias("issue"), i.cast("int").alias("index")))

        return at

    found = [
        issue(size("dates") == 0, "No dates provided"),
        issue(size("preds") == 0, "No predictions provided"),
        issue(size("dates") != size("preds"), "Dates and predictions length mismatch"),
    ]
    for n in ALL_LEVELS:
        low, high = f"lower_{n}", f"upper_{n}"
        if low in names:
            found.append(issue(F.exists(p(low), lambda v: v < 0), f"Negative values in {low}"))
        if low in names and high in names:
            pairs = F.arrays_zip(p(low).alias("l"), p(high).alias("h"))
            found.append(F.array_compact(F.transform(pairs, crossing(f"{low} > {high}"))))
    return documents.select(F.coalesce("adm_1", F.lit("BR")).alias("adm_1"), F.inline(F.concat(*found)))


def documents_from_arrays(arrays: DataFrame) -> DataFrame:
    """A typed forecast table from columns of parallel arrays ``dates, median, ...``."""
    values = [c for c in arrays.columns if c == "median" or c.startswith(("lower_", "upper_"))]
    keep = [c for c in arrays.columns if c not in values and c != "dates"]
    zipped = F.arrays_zip("dates", *values)
    flat = arrays.select(*keep, F.inline(zipped))
    return flat.select(*keep, F.to_date("dates").alias("date"), *[F.col(v).cast("double").alias(v) for v in values])


def plausibility_issues(df: DataFrame, population: str | None = None, keep: tuple[str, ...] = ("uf", "date")) -> DataFrame:
    """Rows breaking ``0 <= lower <= median <= upper <= population``, one per broken rule."""
    checks = []
    for n in levels_of(df, ALL_LEVELS):
        low, high = F.col(f"lower_{n}"), F.col(f"upper_{n}")
        checks += [
            (low > F.col("median"), f"lower_{n} above median"),
            (high < F.col("median"), f"upper_{n} below median"),
            (low < 0, f"lower_{n} negative"),
        ]
    checks.append((F.col("median") < 0, "median negative"))
    if population:
        checks.append((F.col("median") > F.col(population), "median above population"))
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    return df.select(*keep, F.explode(found).alias("issue"))
