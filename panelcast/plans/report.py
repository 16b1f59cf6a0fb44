"""The tables behind reports and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalar import ratio
from panelcast.operators.groups import attach, group_quantiles
from panelcast.operators.scores import by_level, inside

SUMMARY = ["rmse", "mae", "mape", "crps", "wis_total", "bias", "coverage_50", "coverage_95"]


def executive_summary(metrics: DataFrame, names: list[str] = SUMMARY) -> DataFrame:
    """Mean of each metric per model over states."""
    return metrics.groupBy("model").agg(*[F.avg(c).alias(c) for c in names if c in metrics.columns])


def metric_pivot(metrics: DataFrame, metric: str, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """One column per value; stating the values saves Spark a pass to find them."""
    return metrics.groupBy(*rows).pivot(column, values).agg(F.first(metric, ignorenulls=True))


def _band(deviation: Column, near: float, far: float, names: tuple[str, str, str]) -> Column:
    return F.when(deviation < near, names[0]).when(deviation < far, names[1]).otherwise(names[2])


def coverage_bands(metrics: DataFrame, keep: list[str], levels: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Coverage in percent and its distance from target, as good, okay or poor."""
    cells = F.array(*[F.struct(F.lit(n).alias("level"), (F.col(f"coverage_{n}") * 100).alias("pct")) for n in levels])
    deviation = F.abs(F.col("pct") - F.col("level"))
    return (
        metrics.select(*keep, F.inline(cells))
        .where(F.col("pct").isNotNull())
        .withColumn("band", _band(deviation, 10, 20, ("good", "okay", "poor")))
    )


def coverage_quality(metrics: DataFrame, keep: list[str], levels: tuple[int, ...] = (50, 80, 95)) -> DataFrame:
    """Quality of each level and the mean distance from target over levels."""
    pct = {n: F.coalesce(F.col(f"coverage_{n}"), F.lit(0.0)) * 100 for n in levels}
    misses = [F.abs(p - n) for n, p in pct.items()]
    total = misses[0]
    for m in misses[1:]:
        total = total + m
    bands = [
        _band(m, 3, 7, ("excellent", "good", "poor")).alias(f"quality_{n}") for n, m in zip(levels, misses)
    ]
    return metrics.select(*keep, *bands, (total / len(levels)).alias("avg_error"))


def error_box(metrics: DataFrame, names: tuple[str, ...] = ("rmse", "mae", "mape", "bias")) -> DataFrame:
    """Quartiles of each error metric per model."""
    long = metrics.unpivot(["model"], list(names), "metric", "value")
    return group_quantiles(long, ["model", "metric"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def calibration_curve(
    df: DataFrame, by: list[str], truth: str = "casos", levels: tuple[int, ...] = (50, 60, 70, 80, 90, 95)
) -> DataFrame:
    """Empirical coverage at every nominal level the table has bounds for."""
    long = by_level(df, [*by, truth], list(levels))
    hit = inside(F.col(truth).cast("double"), F.col("lower"), F.col("upper"))
    return long.groupBy(*by, "level").agg(F.avg(hit).alias("empirical"))


def residuals(df: DataFrame, truth: str = "casos", keep: tuple[str, ...] = ("uf", "date", "model")) -> DataFrame:
    return df.select(*keep, (F.col(truth) - F.col("median")).alias("residual"))


def residual_histogram(df: DataFrame, by: list[str], bins: int = 30, spread: str = "date") -> DataFrame:
    """Counts of ``residual`` in equal bins between each group's extremes; the last bin
    includes the maximum."""
    ends = df.groupBy(*by).agg(F.min("residual").alias("_lo"), F.max("residual").alias("_hi"))
    share = ratio(F.col("residual") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bin_ = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    return (
        attach(df.where(F.col("residual").isNotNull()), ends, by, [spread])
        .groupBy(*by, bin_.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Numerators and denominators, from the constant term up, of the published rational
# approximations of the normal quantile (AS 241): the middle, the tails and the far tails.
MIDDLE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
TAIL = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
FAR_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """``df`` with the quantile of the standard normal for ``p``, between 0 and 1, as column ``name``."""

    def fraction(parts: tuple[list[float], list[float]], x: Column) -> Column:
        value = []
        for coefficients in parts:
            sum_ = F.lit(coefficients[-1])
            for c in reversed(coefficients[:-1]):
                sum_ = sum_ * x + F.lit(c)
            value.append(sum_)
        return value[0] / value[1]

    # columns of their own, so that the polynomials do not repeat how they are made
    made = df.withColumn("_p", p).withColumn("_r", F.sqrt(-F.log(F.least(F.col("_p"), 1.0 - F.col("_p")))))
    q, r = F.col("_p") - 0.5, F.col("_r")
    tail = F.when(r <= 5.0, fraction(TAIL, r - 1.6)).otherwise(fraction(FAR_TAIL, r - 5.0))
    value = F.when(F.abs(q) <= 0.425, q * fraction(MIDDLE, F.lit(0.180625) - q * q)).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return made.withColumn(name, value).drop("_p", "_r")


# ranks laid out from one row
PIECE = 10_000


def normal_qq(df: DataFrame, by: list[str], cells: int = 64) -> DataFrame:
    """Ordered residuals against the normal quantiles of their plotting positions.

    Ranks come in two steps so that no task sorts a whole group: a sketch splits each
    group into value cells, exact cell counts give each cell's offset, and rows are
    ranked inside their cell. Equal residuals lie in one cell and are counted first.
    """
    values = df.where(F.col("residual").isNotNull()).select(*by, F.col("residual").cast("double").alias("_x"))
    probes = [i / cells for i in range(1, cells)]
    shape = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", probes, 1000).alias("_edges")
    )
    distinct = values.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    placed = attach(distinct, shape, by, ["_x"]).withColumn(
        "_cell", F.size(F.filter("_edges", lambda e: e < F.col("_x")))
    )
    per_cell = placed.groupBy(*by, "_cell").agg(F.sum("_c").alias("_cc"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(*by, "_cell", F.coalesce(F.sum("_cc").over(before), F.lit(0)).alias("_off"))
    order = Window.partitionBy(*by, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(offsets, [*by, "_cell"]).withColumn(
        "_end", F.col("_off") + F.sum("_c").over(order)
    )
    # a value that occurs very often is laid out in pieces, never as one array
    pieces = ranked.select(
        *by, "_n", "_end", F.col("_x").alias("ordered"),
        F.explode(F.sequence(F.col("_end") - F.col("_c") + 1, F.col("_end"), F.lit(PIECE))).alias("_from"),
    )
    each = pieces.select(
        *by, "_n", "ordered", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + PIECE - 1, F.col("_end")))).alias("rank")
    )
    n = F.col("_n").cast("double")
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    position = (
        F.when(F.col("rank") == F.col("_n"), last)
        .when(F.col("rank") == 1, 1.0 - last)
        .otherwise((F.col("rank") - 0.3175) / (n + 0.365))
    )
    return with_normal_quantile(each, position, "theoretical").select(*by, "rank", "ordered", "theoretical")


def normalized_heatmap(metrics: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """Each metric scaled to [0, 1] over all rows; a constant metric becomes 0.5."""
    ends = metrics.agg(
        *[F.min(c).alias(f"_lo_{c}") for c in names], *[F.max(c).alias(f"_hi_{c}") for c in names]
    )
    rows = attach(metrics, ends, [], keep)

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    return rows.select(*keep, *[scaled(c).alias(c) for c in names])


def performance_matrix(metrics: DataFrame, metric: str, tests: list[str], by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    """A model's metric in each test and its average."""
    at = [F.max(F.when(F.col("test") == t, F.col(metric))).alias(f"test_{t}") for t in tests]
    return metrics.groupBy(*by).agg(*at, F.avg(metric).alias("average"))


def coverage_table(metrics: DataFrame, levels: tuple[int, ...] = (50, 80, 95)) -> DataFrame:
    """Target and mean actual coverage in percent per model and level."""
    cells = F.array(*[F.struct(F.lit(n).alias("target"), F.col(f"coverage_{n}").alias("_c")) for n in levels])
    return (
        metrics.select("model", F.inline(cells))
        .groupBy("model", "target")
        .agg((F.avg("_c") * 100).alias("actual"))
    )


def crps_trend(metrics: DataFrame, by: tuple[str, ...] = ("uf", "model")) -> DataFrame:
    """CRPS of the first and last test and the improvement in percent."""
    first, last = F.min_by("crps", "test"), F.max_by("crps", "test")
    return metrics.where(F.col("crps").isNotNull()).groupBy(*by).agg(
        first.alias("first_crps"),
        last.alias("last_crps"),
        (ratio(first - last, first) * 100).alias("improvement_pct"),
    )


def insight_flags(metrics: DataFrame, by: tuple[str, ...] = ("uf",)) -> DataFrame:
    """Whether mean CRPS fell from first to last test, and whether every 95 % interval
    covered at least 90 %."""
    tests = metrics.groupBy(*by, "test").agg(
        F.avg("crps").alias("crps"), F.bool_and(F.col("coverage_95") >= 0.90).alias("covered")
    )
    first, last = F.min_by("crps", "test"), F.max_by("crps", "test")
    return tests.groupBy(*by).agg(
        F.when(last < first, ratio(first - last, first) * 100).alias("improvement_pct"),
        F.bool_and("covered").alias("well_calibrated"),
    )


def forecast_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.min("median").alias("median_min"),
        F.max("median").alias("median_max"),
        F.avg("median").alias("median_mean"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """States in total, finished and failed, from ``(uf, status)``."""
    states = results.groupBy("uf").agg(F.bool_and(F.col("status") == "success").alias("ok"))
    return states.agg(
        F.count(F.lit(1)).alias("total_states"),
        F.count_if("ok").alias("successful_states"),
        F.count_if(~F.col("ok")).alias("failed_states"),
    )


def score_summary(metrics: DataFrame, by: tuple[str, ...] = ("uf",)) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.avg("crps").alias("avg_crps"),
        F.min("crps").alias("best_crps"),
        F.avg("wis_total").alias("avg_wis"),
        F.min("wis_total").alias("best_wis"),
    )


def round_summary(rounds: DataFrame, models: list[str], target: str = "crps") -> DataFrame:
    """Per tuning round: mean scores over models and each model's scores side by side."""
    side = [
        F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}") for m in models for c in (target, "rmse", "mae")
    ]
    return rounds.groupBy("round").agg(
        F.avg(target).alias(target), F.avg("rmse").alias("rmse_mean"), F.avg("mae").alias("mae_mean"), *side
    )


def importance_mean(importances: DataFrame, top: int | None = None) -> DataFrame:
    """Mean importance of each feature over quantile models, highest first."""
    means = importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
    ordered = means.orderBy(F.desc("importance"), "feature")
    return ordered.limit(top) if top else ordered
