"""Learned models in rolling-season backtests, from what was known at each cutoff.

A forecast for a week is made from features of its origin, the end of a test's training data: recent
means, the same week of earlier seasons, the horizon. The learning rows look the same: a grid of earlier
origins, each with every horizon, is laid over each series, and a booster learns only rows whose week
lies before its test's cutoff. All tests and quantile levels are grown together, on one table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.reference import BACKTEST_SEASONS
from panelcast.functions.scalar import cycle
from panelcast.operators import boosting
from panelcast.operators.learned import fit_linear, moments, predict_linear, residual_intervals, seasonal_design
from panelcast.operators.scores import QUANTILE_COLUMNS
from panelcast.operators.seasons import assign_seasons
from panelcast.plans.backtest import score_seasons, season_forecasts
from panelcast.series import Series, over_chunks
from panelcast.session import cut_lineage

# days between the origins of learning rows, and days of a season; whole weeks
STEP = 91
SEASON = 364
FEATURES = ["recent", "mean_4", "mean_12", "like_1", "like_2", "level", "horizon", "week_sin", "week_cos"]


def _day(date: str) -> int:
    return (dt.date.fromisoformat(date) - dt.date(1970, 1, 1)).days


def origin_features(panel: DataFrame, seasons: list[tuple], target: str = "casos", s: Series = Series(), step: int = STEP) -> DataFrame:
    """The state of every series at every origin: (key, origin, test) with its latest value and the means of its
    latest 4, 12 and 52 rows, as logarithms. ``test`` is null on the grid of learning origins, which are
    whole ``step`` apart up to the last cutoff. An origin needs a row in the ``step`` days up to it."""
    y = F.log1p(F.col(target).cast("double"))

    def means(w) -> dict[str, Column]:
        out = {"_y": F.avg(y).over(w.rowsBetween(0, 0))}
        return out | {f"_m{n}": F.avg(y).over(w.rowsBetween(-n + 1, 0)) for n in (3, 4, 12, 52)}

    known = panel.where(F.col(target).isNotNull()).select(*s.key, s.time, target)
    rows = cut_lineage(over_chunks(known, means, s, before=52))
    day = F.unix_date(F.col(s.time).cast("date"))
    ends = {name: _day(end) for name, _, end, _, _ in seasons}
    last = max(ends.values())
    grid = F.lit(last) - F.floor((F.lit(last) - day) / step).cast("int") * step
    origins = [F.when(day <= last, F.struct(grid.alias("origin"), F.lit(None).cast("string").alias("test")))]
    origins += [F.when((day <= e) & (day > e - step), F.struct(F.lit(e).alias("origin"), F.lit(t).alias("test"))) for t, e in ends.items()]
    copies = rows.select(*s.key, F.inline(F.array_compact(F.array(*origins))), day.alias("_at"), "_y", "_m4", "_m12", "_m52")
    state = F.struct("_y", "_m4", "_m12", "_m52")
    return copies.groupBy(*s.key, "origin", "test").agg(F.max_by(state, "_at").alias("_s")).select(*s.key, "origin", "test", "_s.*")


def direct_rows(panel: DataFrame, seasons: list[tuple], target: str = "casos", s: Series = Series(), step: int = STEP) -> DataFrame:
    """Learning and forecast rows of ``FEATURES``: (key, test, date, origin, base, label).

    ``test`` is null for learning rows, which have every horizon that some test asks for, and for weeks
    that have been observed by the last cutoff. ``label`` is the week's log value less ``base``, the level
    at the origin; features are relative to it too, so series of any size teach each other.
    """
    horizons = sorted({h for _, _, end, a, b in seasons for h in range(_day(a) - _day(end), _day(b) - _day(end) + 1, 7)})
    last = max(_day(end) for _, _, end, _, _ in seasons)
    states = origin_features(panel, seasons, target, s, step)
    of_test = {t: F.array(*[F.lit(h) for h in range(_day(a) - _day(end), _day(b) - _day(end) + 1, 7)]) for t, _, end, a, b in seasons}
    ahead = F.array(*[F.lit(h) for h in horizons])
    for t, own in of_test.items():
        ahead = F.when(F.col("test") == t, own).otherwise(ahead)
    rows = states.withColumn("horizon", F.explode(ahead))
    day = F.col("origin") + F.col("horizon")
    like = day - (F.ceil(F.col("horizon") / SEASON) * SEASON).cast("int")
    rows = rows.withColumns({"_day": day, "_like_1": like, "_like_2": like - SEASON}).where(F.col("test").isNotNull() | (F.col("_day") <= last))
    y = F.log1p(F.col(target).cast("double"))
    # the mean of a week and the two before it: nothing later than the week, which is no later than the origin
    weekly = panel.where(F.col(target).isNotNull()).select(*s.key, s.time, target)
    seen = cut_lineage(over_chunks(weekly, lambda w: {"_like": F.avg(y).over(w.rowsBetween(-2, 0)), "_seen": y}, s, before=2).select(*s.key, F.unix_date(F.col(s.time).cast("date")).alias("_d"), "_like", "_seen"))
    for name, column in (("like_1", "_like"), ("like_2", "_like"), ("_seen", "_seen")):
        at = "_day" if name == "_seen" else f"_{name}"
        rows = rows.join(seen.select(*s.key, F.col("_d").alias(at), F.col(column).alias(name)), [*s.key, at], "left")
    rows = rows.where(F.col("test").isNotNull() | F.col("_seen").isNotNull())
    base = F.col("_m52")
    date = F.date_from_unix_date("_day")
    week_sin, week_cos = cycle(F.weekofyear(date), 52)
    return rows.select(
        *s.key, "test", date.alias(s.time), F.date_from_unix_date("origin").alias("origin"), base.alias("base"),
        # a forecast row's own week is not known to it
        F.when(F.col("test").isNull(), F.col("_seen") - base).alias("label"),
        (F.col("_y") - base).alias("recent"), (F.col("_m4") - base).alias("mean_4"), (F.col("_m12") - base).alias("mean_12"),
        (F.col("like_1") - base).alias("like_1"), (F.col("like_2") - base).alias("like_2"), base.alias("level"),
        "horizon", week_sin.alias("week_sin"), week_cos.alias("week_cos"),
    )


def fit_direct(panel: DataFrame, seasons: list[tuple], target: str = "casos", s: Series = Series(), levels: dict[str, float] | None = None, **settings) -> tuple[DataFrame, boosting.Model]:
    """``direct_rows``, written, and one booster per test and quantile level. Each knows only rows up to its
    test's cutoff; the cuts of the bins are those of rows up to the first cutoff."""
    rows = cut_lineage(direct_rows(panel, seasons, target, s))
    boosters = [boosting.Booster(f"{t}/{c}", q, until=_day(end), **settings) for t, _, end, _, _ in seasons for c, q in (levels or QUANTILE_COLUMNS).items()]
    learning = rows.where("test is null")
    return rows, boosting.fit(learning, FEATURES, "label", boosters, s.time, cuts_until=min(_day(x[2]) for x in seasons))


def tree_forecasts(panel: DataFrame, seasons: list[tuple] = BACKTEST_SEASONS, target: str = "casos", s: Series = Series(), **settings) -> DataFrame:
    """Forecasts of quantile boosting for every week of each test's target window, in the columns of
    ``season_forecasts``; see ``fit_direct``."""
    rows, model = fit_direct(panel, seasons, target, s, **settings)
    told = boosting.predict(rows.where("test is not null"), model, [*s.key, "test", s.time, "base"])
    levels = len(QUANTILE_COLUMNS)
    first = F.lit(None).cast("int")
    for i, x in enumerate(seasons):
        first = F.when(F.col("test") == x[0], i * levels).otherwise(first)
    # levels are grown apart, so their forecasts are put in order
    ordered = F.array_sort(F.slice("_pred", first + 1, levels))
    rank = {c: i for i, c in enumerate(sorted(QUANTILE_COLUMNS, key=QUANTILE_COLUMNS.get))}
    values = [F.greatest(F.expm1(F.col("base") + F.get("_q", F.lit(rank[c]))), F.lit(0.0)).alias(c) for c in QUANTILE_COLUMNS]
    return told.withColumn("_q", ordered).select(*s.key, "test", F.lit("quantile_trees").alias("model"), s.time, *values)


def regression_forecasts(panel: DataFrame, seasons: list[tuple] = BACKTEST_SEASONS, target: str = "casos", penalty: float = 1e-4, s: Series = Series(), **design) -> DataFrame:
    """Forecasts of the trend-and-season regression of log values, one model per series and test, fitted on
    the test's training rows, for every week of its target window."""
    keyed = Series(key=(*s.key, "test"), time=s.time, chunk_rows=s.chunk_rows)
    known = assign_seasons(panel.where(F.col(target).isNotNull()).select(*s.key, s.time, target), seasons, s.time).where(F.col("role") == "train")
    known = known.select(*keyed.key, s.time, F.log1p(F.col(target).cast("double")).alias("_ly"))
    weeks = F.lit(None).cast("array<date>")
    for t, _, _, a, b in seasons:
        weeks = F.when(F.col("test") == t, F.sequence(F.lit(a).cast("date"), F.lit(b).cast("date"), F.expr("interval 7 days"))).otherwise(weeks)
    ahead = known.groupBy(*keyed.key).agg(F.count("*").alias("_n")).select(*keyed.key, F.explode(weeks).alias(s.time), F.lit(None).cast("double").alias("_ly"))
    rows = cut_lineage(known.unionByName(ahead))
    # spans of time are those of training rows
    placed = seasonal_design(rows, keyed, known=F.col("_ly").isNotNull(), **design)
    betas = cut_lineage(fit_linear(moments(placed, "_ly", keyed.key, keyed), keyed.key, penalty))
    fitted = cut_lineage(predict_linear(placed, betas, keyed.key, "_yhat", keyed).select(*keyed.key, s.time, "_ly", "_yhat").where("_yhat is not null"))
    residual = fitted.where("_ly is not null").select(*keyed.key, (F.col("_ly") - F.col("_yhat")).alias("_res"))
    out = residual_intervals(fitted.where("_ly is null"), residual, keyed.key, "_yhat", F.expm1, keyed)
    return out.select(*keyed.key, F.lit("seasonal_regression").alias("model"), s.time, *QUANTILE_COLUMNS)


def learned_forecasts(panel: DataFrame, seasons: list[tuple] = BACKTEST_SEASONS, target: str = "casos", s: Series = Series(), trees: dict | None = None, regression: dict | None = None) -> DataFrame:
    """Baselines, regression and trees under one ``model`` column: everything a test's cutoff admits."""
    columns = [*s.key, "test", "model", s.time, *QUANTILE_COLUMNS]
    out = season_forecasts(panel, seasons, target, s=s).select(*columns)
    out = out.unionByName(regression_forecasts(panel, seasons, target, s=s, **(regression or {})).select(*columns))
    return out.unionByName(tree_forecasts(panel, seasons, target, s, **(trees or {})).select(*columns))


def backtest_models(panel: DataFrame, seasons: list[tuple] = BACKTEST_SEASONS, target: str = "casos", s: Series = Series(), **models) -> DataFrame:
    """Scores of baselines and learned models per series, test and model."""
    panel = cut_lineage(panel)
    return score_seasons(cut_lineage(learned_forecasts(panel, seasons, target, s, **models)), panel, target, s=s)


def selected_forecasts(forecasts: DataFrame, chosen: DataFrame, key: tuple[str, ...] = ("uf",)) -> DataFrame:
    """The forecasts of each series' own selected models: ``chosen`` has key, model and rank."""
    return forecasts.join(chosen.select(*key, "model", "rank"), [*key, "model"])
