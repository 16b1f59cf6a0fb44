"""Report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.registry import register
from panelcast.operators.scores import ALL_LEVELS
from panelcast.plans import report as r
from panelcast.session import cut_lineage

MODELS = ["naive", "seasonal", "mean12"]
COL = t.score_columns(ALL_LEVELS)


def stored_metrics(s, d):
    return cut_lineage(t.metrics(s, d))


register("r1_executive_summary", lambda s, d: r.executive_summary(t.metrics(s, d)),
    f"SELECT model, {', '.join(f'avg({c}) AS {c}' for c in r.SUMMARY)} FROM fx_metrics GROUP BY model", r.SUMMARY)
register("r2_per_state_detail", lambda s, d: t.metrics(s, d).select("uf", "model", *r.SUMMARY),
    f"SELECT uf, model, {', '.join(r.SUMMARY)} FROM fx_metrics", r.SUMMARY)
register("r3_metric_pivot", lambda s, d: r.metric_pivot(t.metrics(s, d), "rmse", ["uf"], "model", MODELS),
    "SELECT uf, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN rmse END) AS {m}" for m in MODELS) + " FROM fx_metrics GROUP BY uf", MODELS)
register("r4_coverage_bands", lambda s, d: r.coverage_bands(t.metrics(s, d), ["uf", "model"]),
    " UNION ALL ".join(
        f"""SELECT uf, model, {n} AS level, coverage_{n} * 100 AS pct, CASE WHEN abs(coverage_{n} * 100 - {n}) < 10 THEN 'good'
            WHEN abs(coverage_{n} * 100 - {n}) < 20 THEN 'okay' ELSE 'poor' END AS band FROM fx_metrics""" for n in (50, 95)), "pct")
register("r5_coverage_quality", lambda s, d: r.coverage_quality(t.tests(s, d), ["uf", "test", "model"]),
    "SELECT uf, test, model, " + ", ".join(
        f"CASE WHEN abs(coverage_{n} * 100 - {n}) < 3 THEN 'excellent' WHEN abs(coverage_{n} * 100 - {n}) < 7 THEN 'good' ELSE 'poor' END AS quality_{n}"
        for n in (50, 80, 95)) + ", (abs(coverage_50 * 100 - 50) + abs(coverage_80 * 100 - 80) + abs(coverage_95 * 100 - 95)) / 3 AS avg_error FROM fx_tests", "avg_error")
register("r6_error_box", lambda s, d: r.error_box(stored_metrics(s, d)),
    """SELECT model, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3
       FROM (UNPIVOT (SELECT model, rmse, mae, mape, bias FROM fx_metrics) ON rmse, mae, mape, bias INTO NAME metric VALUE value) GROUP BY model, metric""",
    "q1 q2 q3")
register("r7_calibration_curve", lambda s, d: r.calibration_curve(t.forecast(s, d), ["model"]),
    " UNION ALL ".join(f"SELECT model, {n} AS level, {COL[f'coverage_{n}']} AS empirical FROM fx_forecast GROUP BY model" for n in ALL_LEVELS), "empirical")
register("r8_residuals", lambda s, d: r.residuals(t.forecast(s, d)), "SELECT uf, date, model, casos - median AS residual FROM fx_forecast", "residual")
register("r8_residual_histogram",
    lambda s, d: r.residual_histogram(r.residuals(t.forecast(s, d)).withColumn("residual", F.col("residual") + 0.01237), ["model"]),
    """SELECT model, CAST(least(floor((r - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM
       (SELECT model, casos - median + 0.01237 AS r, min(casos - median + 0.01237) OVER w AS lo, max(casos - median + 0.01237) OVER w AS hi
        FROM fx_forecast WINDOW w AS (PARTITION BY model)) GROUP BY 1, 2""")
register("r9_normal_qq", lambda s, d: r.normal_qq(cut_lineage(r.residuals(t.forecast(s, d))), ["model"]))
register("r9_ordered_residuals", lambda s, d: r.normal_qq(cut_lineage(r.residuals(t.forecast(s, d))), ["model"]).drop("theoretical"),
    """SELECT model, row_number() OVER (PARTITION BY model ORDER BY casos - median) AS rank, casos - median AS ordered FROM fx_forecast""", "ordered")
HEAT = ["rmse", "mae", "mape", "crps", "wis_total"]
register("r10_normalized_heatmap", lambda s, d: r.normalized_heatmap(stored_metrics(s, d), ["uf", "model"], HEAT),
    "SELECT uf, model, " + ", ".join(
        f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END AS {c}" for c in HEAT)
    + " FROM fx_metrics", HEAT)
for _metric in ("crps", "wis_total"):
    register(f"r11_{_metric}_progression", lambda s, d, k=_metric: r.metric_pivot(t.tests(s, d), k, ["uf", "test"], "model", MODELS),
        "SELECT uf, test, " + ", ".join(f"max(CASE WHEN model = '{m}' THEN {_metric} END) AS {m}" for m in MODELS) + " FROM fx_tests GROUP BY uf, test", MODELS)
register("r12_performance_matrix", lambda s, d: r.performance_matrix(t.tests(s, d), "mae", ["1", "2", "3"]),
    "SELECT uf, model, " + ", ".join(f"max(CASE WHEN test = '{k}' THEN mae END) AS test_{k}" for k in "123") + ", avg(mae) AS average FROM fx_tests GROUP BY uf, model",
    "test_1 test_2 test_3 average")
register("r13_coverage_table", lambda s, d: r.coverage_table(t.tests(s, d)),
    " UNION ALL ".join(f"SELECT model, {n} AS target, avg(coverage_{n}) * 100 AS actual FROM fx_tests GROUP BY model" for n in (50, 80, 95)), "actual")
register("w14_crps_trend", lambda s, d: r.crps_trend(t.tests(s, d)),
    """SELECT uf, model, min_by(crps, test) AS first_crps, max_by(crps, test) AS last_crps,
       (min_by(crps, test) - max_by(crps, test)) / nullif(min_by(crps, test), 0) * 100 AS improvement_pct FROM fx_tests GROUP BY uf, model""",
    "first_crps last_crps improvement_pct")
register("r14_insight_flags", lambda s, d: r.insight_flags(t.tests(s, d)),
    """SELECT uf, CASE WHEN max_by(crps, test) < min_by(crps, test) THEN (min_by(crps, test) - max_by(crps, test)) / nullif(min_by(crps, test), 0) * 100 END AS improvement_pct,
       bool_and(covered) AS well_calibrated FROM (SELECT uf, test, avg(crps) AS crps, bool_and(coverage_95 >= 0.9) AS covered FROM fx_tests GROUP BY uf, test) GROUP BY uf""",
    "improvement_pct")
register("r15_forecast_summary", lambda s, d: r.forecast_summary(t.forecast(s, d), ["uf", "model"]),
    "SELECT uf, model, count(*) AS weeks, min(median) AS median_min, max(median) AS median_max, avg(median) AS median_mean FROM fx_forecast GROUP BY uf, model",
    "median_min median_max median_mean")
register("a13_run_summary",
    lambda s, d: r.run_summary(t.tests(s, d).select("uf", F.when(F.col("coverage_95") >= 0.7, "success").otherwise("failed").alias("status"))),
    """SELECT count(*) AS total_states, count(*) FILTER (ok) AS successful_states, count(*) FILTER (NOT ok) AS failed_states
       FROM (SELECT uf, bool_and(coverage_95 >= 0.7) AS ok FROM fx_tests GROUP BY uf)""")
register("a15_score_summary", lambda s, d: r.score_summary(t.tests(s, d)),
    "SELECT uf, avg(crps) AS avg_crps, min(crps) AS best_crps, avg(wis_total) AS avg_wis, min(wis_total) AS best_wis FROM fx_tests GROUP BY uf",
    "avg_crps best_crps avg_wis best_wis")
SIDE = [f"{m}_{c}" for m in MODELS for c in ("crps", "rmse", "mae")]
register("a17_round_summary",
    lambda s, d: r.round_summary(t.tests(s, d).groupBy(F.col("test").alias("round"), "model").agg(*[F.avg(c).alias(c) for c in ("crps", "rmse", "mae")]), MODELS),
    "SELECT round, avg(crps) AS crps, avg(rmse) AS rmse_mean, avg(mae) AS mae_mean, " + ", ".join(
        f"max(CASE WHEN model = '{m}' THEN {c} END) AS {m}_{c}" for m in MODELS for c in ("crps", "rmse", "mae"))
    + " FROM (SELECT test AS round, model, avg(crps) AS crps, avg(rmse) AS rmse, avg(mae) AS mae FROM fx_tests GROUP BY 1, 2) GROUP BY round",
    ["crps", "rmse_mean", "mae_mean", *SIDE])
