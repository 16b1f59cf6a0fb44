"""Scores of forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.registry import register
from panelcast.operators import scores as m
from panelcast.session import cut_lineage


COL = t.score_columns(m.ALL_LEVELS)


def _by_model(s, d, **made):
    return t.forecast(s, d).groupBy("uf", "model").agg(*[c.alias(n) for n, c in made.items()])


def _one(name, build, sql):
    register(name,
        lambda s, d: _by_model(s, d, value=build()), f"SELECT uf, model, {sql} AS value FROM fx_forecast GROUP BY uf, model", "value")



_one("m1_rmse", lambda: m.rmse(F.col("casos"), F.col("median")), COL["rmse"])
_one("m2_mae", lambda: m.mae(F.col("casos"), F.col("median")), COL["mae"])
_one("m3_mape", lambda: m.mape(F.col("casos"), F.col("median")), COL["mape"])
register("m4_crps_row",
    lambda s, d: _with_row(t.forecast(s, d)),
    f"SELECT uf, date, model, {t.crps_sql()} AS crps FROM fx_forecast", "crps")
register("m5_crps_custom_columns",
    lambda s, d: _custom_crps(t.forecast(s, d)),
    f"SELECT uf, model, avg({t.crps_sql(names=['lower_90', 'lower_80', 'median', 'upper_80', 'upper_90'])}) AS crps FROM fx_forecast GROUP BY uf, model", "crps")
_one("m5_crps", lambda: F.avg(m.crps_row(F.col("casos"), [(m.QUANTILE_COLUMNS[c], F.col(c)) for c in m.CRPS_COLUMNS])), COL["crps"])
_one("m6_wis_95", lambda: F.avg(m.wis_row(F.col("casos"), F.col("lower_95"), F.col("upper_95"), F.col("median"), 0.05)), COL["wis_95"])
register("m7_wis_total", lambda s, d: _wis_total(t.forecast(s, d)),
    f"""SELECT uf, model, avg(({' + '.join(t.wis_sql(n) for n in m.ALL_LEVELS)}) / 4) AS equal_weights,
        avg(0.5 * {t.wis_sql(50)} + 0.3 * {t.wis_sql(80)} + 0.2 * {t.wis_sql(95)}) AS given_weights FROM fx_forecast GROUP BY uf, model""",
    "equal_weights given_weights")
register("m8_log_score",
    lambda s, d: m.log_score(t.forecast(s, d), ["uf", "model"], "sd").join(
        m.log_score(t.forecast(s, d), ["uf", "model"], "sd", proper=True).withColumnRenamed("log_score", "proper_score"), ["uf", "model"]),
    """SELECT uf, model, avg(0.5 * ln(2 * pi()) + z * z / 2 - ln(g)) AS log_score, avg(0.5 * ln(2 * pi()) + z * z / 2 + ln(g)) AS proper_score
       FROM (SELECT *, greatest(sd, 1e-6) AS g, (casos - median) / greatest(sd, 1e-6) AS z FROM fx_forecast) GROUP BY uf, model""",
    "log_score proper_score")
register("m9_coverage", lambda s, d: m.evaluate(t.forecast(s, d), ["model"], levels=m.ALL_LEVELS).select("model", *[f"coverage_{n}" for n in m.ALL_LEVELS]),
    f"SELECT model, {', '.join(COL[f'coverage_{n}'] + f' AS coverage_{n}' for n in m.ALL_LEVELS)} FROM fx_forecast GROUP BY model",
    [f"coverage_{n}" for n in m.ALL_LEVELS])
_one("m10_interval_width", lambda: F.avg(F.col("upper_80") - F.col("lower_80")), COL["width_80"])
register("m11_sharpness", lambda s, d: m.sharpness(t.forecast(s, d), ["uf", "model"], 95),
    """SELECT uf, model, avg(upper_95 - lower_95) AS sharpness, avg((upper_95 - lower_95) / greatest(casos, 1)) AS relative_sharpness
       FROM fx_forecast GROUP BY uf, model""", "sharpness relative_sharpness")
_one("m12_bias", lambda: m.bias(F.col("casos"), F.col("median")), COL["bias"])
for _metric in ("rmse", "mae", "mape"):
    register(f"m13_skill_{_metric}", lambda s, d, k=_metric: m.skill_score(cut_lineage(t.forecast(s, d)), "naive", k),
        f"""SELECT uf, model, 1 - {COL[_metric]} / nullif({COL[_metric].replace('median', 'base')}, 0) AS skill
            FROM fx_forecast JOIN (SELECT uf, date, median AS base FROM fx_forecast WHERE model = 'naive') USING (uf, date)
            WHERE model <> 'naive' GROUP BY uf, model""", "skill")
register("j12_paired_with_baseline",
    lambda s, d: _paired(cut_lineage(t.forecast(s, d))),
    """SELECT f.uf, f.date, f.model, f.median, b.median AS base FROM fx_forecast f
       JOIN fx_forecast b ON b.uf = f.uf AND b.date = f.date AND b.model = 'seasonal' WHERE f.model <> 'seasonal'""", "median base")
register("m14_evaluate_forecast", lambda s, d: t.metrics(s, d), "SELECT * FROM fx_metrics", t.SCORE_NAMES)
register("m14_evaluate_missing_levels",
    lambda s, d: m.evaluate(t.forecast(s, d).select("uf", "date", "model", "casos", F.when(F.col("casos") > 1, F.col("median")).alias("median"), "lower_50", "upper_50"), ["model"]),
    f"""SELECT model, {', '.join(f'{COL[c]} AS {c}' for c in ('rmse', 'mae', 'mape', 'bias', 'coverage_50', 'wis_50', 'width_50'))},
        avg({t.crps_sql(names=['lower_50', 'median', 'upper_50'])}) AS crps,
        avg(({' + '.join(t.pinball_sql('casos', m.QUANTILE_COLUMNS[c], c) for c in ('lower_50', 'median', 'upper_50'))}) * 2 / 3) AS crps_pinball,
        avg({t.wis_sql(50)}) AS wis_total FROM fx_forecast WHERE casos > 1 GROUP BY model""",
    "rmse mae mape bias coverage_50 wis_50 width_50 crps crps_pinball wis_total")
register("m15_compare_models", lambda s, d: m.evaluate(t.forecast(s, d), ["model"]),
    f"SELECT model, {t.score_sql(m.LEVELS)} FROM fx_forecast GROUP BY model", t.SCORE_NAMES_3)
register("m16_coverage_error", lambda s, d: m.coverage_errors(t.forecast(s, d), ["uf", "model"]),
    f"SELECT uf, model, {', '.join(f'abs(coverage_{n} - {n} / 100.0::DOUBLE) AS coverage_error_{n}' for n in m.ALL_LEVELS)} FROM fx_metrics",
    [f"coverage_error_{n}" for n in m.ALL_LEVELS])
register("m17_interval_validation", lambda s, d: m.interval_validation(t.forecast(s, d), ["model"]),
    " UNION ALL ".join(
        f"""SELECT model, {n} AS level, {COL[f'coverage_{n}']} AS actual_coverage, count(*) FILTER (casos < lower_{n}) AS n_below,
            count(*) FILTER (casos > upper_{n}) AS n_above, {COL[f'width_{n}']} AS mean_width, {n} / 100.0::DOUBLE AS expected_coverage,
            abs({COL[f'coverage_{n}']} - {n} / 100.0::DOUBLE) AS coverage_error FROM fx_forecast GROUP BY model""" for n in m.ALL_LEVELS),
    "actual_coverage mean_width expected_coverage coverage_error")
register("m18_validation_passed", lambda s, d: m.validation_passed(t.metrics(s, d), ["uf"], max_crps=3.0),
    f"SELECT uf, bool_and(crps <= 3.0 AND {' AND '.join(f'coverage_{n} >= 0.85 * {n} / 100.0' for n in m.ALL_LEVELS)}) AS passed FROM fx_metrics GROUP BY uf")
register("m19_overfitting",
    lambda s, d: _overfit(s, d),
    f"""SELECT uf, model, v.rmse / nullif(r.rmse, 0) AS ratio_rmse, v.mae / nullif(r.mae, 0) AS ratio_mae,
        CASE WHEN r.crps > 0 THEN v.crps / r.crps END AS ratio_crps,
        coalesce(v.rmse / nullif(r.rmse, 0) > 1.3, false) OR coalesce(v.mae / nullif(r.mae, 0) > 1.3, false)
          OR coalesce(CASE WHEN r.crps > 0 THEN v.crps / r.crps END > 1.3, false) AS overfitting
        FROM (SELECT uf, model, {t.score_sql(m.LEVELS)} FROM fx_forecast WHERE date <= DATE '{t.TRAIN_END}' GROUP BY uf, model) r
        JOIN (SELECT uf, model, {t.score_sql(m.LEVELS)} FROM fx_forecast WHERE date > DATE '{t.TRAIN_END}' GROUP BY uf, model) v USING (uf, model)""",
    "ratio_rmse ratio_mae ratio_crps")
register("m20_tuning_metrics", lambda s, d: t.metrics(s, d).select("uf", "model", "rmse", "mae", "crps", "coverage_95", "coverage_50"),
    "SELECT uf, model, rmse, mae, crps, coverage_95, coverage_50 FROM fx_metrics", "rmse mae crps coverage_95 coverage_50")
_one("m21_crps_pinball", lambda: F.avg(m.pinball_row(F.col("casos"), [(m.QUANTILE_COLUMNS[c], F.col(c)) for c in m.CRPS_COLUMNS])), COL["crps_pinball"])
register("p7_valid_median_rows",
    lambda s, d: t.forecast(s, d).withColumn("median", F.when(F.col("casos") > 1, F.col("median"))).where(F.col("median").isNotNull()).groupBy("model").agg(F.count(F.lit(1)).alias("n")),
    "SELECT model, count(*) AS n FROM fx_forecast WHERE casos > 1 GROUP BY model")
register("o3_best_model", lambda s, d: m.best_model(t.metrics(s, d), ["uf"], "rmse"),
    "SELECT uf, model AS best_model, rmse AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY uf ORDER BY rmse, model) AS rn FROM fx_metrics) WHERE rn = 1",
    "best_score")
MODEL = f"(SELECT model, {t.score_sql(m.LEVELS)} FROM fx_forecast GROUP BY model)"
LONG = f"(UNPIVOT {MODEL} ON rmse, mae, mape, crps, wis_total, coverage_50, coverage_80, coverage_95 INTO NAME metric VALUE value)"
register("o4_best_per_metric", lambda s, d: m.best_per_metric(m.evaluate(t.forecast(s, d), ["model"]), m.LEADERBOARD),
    f"""SELECT metric, model AS best_model, value AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, model) AS rn
        FROM {LONG} WHERE metric NOT LIKE 'coverage%') WHERE rn = 1""", "best_value")
register("o5_leaderboard", lambda s, d: m.leaderboard(m.evaluate(t.forecast(s, d), ["model"])),
    f"""SELECT model, metric, value, CAST(row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric LIKE 'coverage%' THEN -value ELSE value END, model) AS INTEGER) AS rank
        FROM {LONG}""", "value")


def _with_row(df):
    q = m.quantiles_of(df)
    return df.select("uf", "date", "model", m.crps_row(F.col("casos").cast("double"), q).alias("crps"))


def _custom_crps(df):
    q = m.quantiles_of(df, ["lower_90", "lower_80", "median", "upper_80", "upper_90"])
    return df.groupBy("uf", "model").agg(F.avg(m.crps_row(F.col("casos").cast("double"), q)).alias("crps"))


def _wis_total(df):
    y = F.col("casos").cast("double")
    return df.groupBy("uf", "model").agg(
        F.avg(m.wis_total_row(df, y, m.ALL_LEVELS)).alias("equal_weights"),
        F.avg(m.wis_total_row(df, y, m.LEVELS, [0.5, 0.3, 0.2])).alias("given_weights"),
    )


def _paired(df):
    base = df.where(F.col("model") == "seasonal").select("uf", "date", F.col("median").alias("base"))
    return df.where(F.col("model") != "seasonal").select("uf", "date", "model", "median").join(base, ["uf", "date"])


def _overfit(s, d):
    df = cut_lineage(t.forecast(s, d))
    end = F.lit(t.TRAIN_END).cast("date")
    return m.overfitting(
        m.evaluate(df.where(F.col("date") <= end), ["uf", "model"]), m.evaluate(df.where(F.col("date") > end), ["uf", "model"]), ["uf", "model"]
    )
