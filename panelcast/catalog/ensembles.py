"""Combining and calibrating models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.registry import register
from panelcast.operators import ensemble as e
from panelcast.operators.scores import ALL_LEVELS, LEVELS
from panelcast.session import cut_lineage

COLS = ["median"] + [c for n in ALL_LEVELS for c in (f"lower_{n}", f"upper_{n}")]
COLS3 = ["median"] + [c for n in LEVELS for c in (f"lower_{n}", f"upper_{n}")]


def stored(s, d):
    """Forecasts written once: weights, combination and scores each read them."""
    return cut_lineage(t.forecast(s, d))


def weights_sql(metric: str) -> str:
    inverse = f"CASE WHEN {metric} >= 0 THEN 1 / ({metric} + 1e-8) END"
    return f"SELECT uf, model, {metric} AS score, {inverse} / sum({inverse}) OVER (PARTITION BY uf) AS weight FROM fx_metrics"


def average_sql(weights: str | None, cols: list[str] = COLS, clip: bool = True) -> str:
    w = "w.weight" if weights else "1"
    join = f"LEFT JOIN ({weights}) w ON w.uf = f.uf AND w.model = f.model" if weights else ""
    parts = []
    for c in cols:
        mean = f"sum(coalesce({w}, 0) * f.{c}) / nullif(sum(coalesce({w}, 0)), 0)"
        parts.append(f"greatest({mean}, 0) AS {c}" if clip and not c.startswith("upper") else f"{mean} AS {c}")
    return f"SELECT f.uf, f.date, {', '.join(parts)} FROM fx_forecast f {join} GROUP BY f.uf, f.date"


for _metric in e.METRICS:
    register(f"e1_fit_weights_{_metric}", lambda s, d, k=_metric: e.fit_weights(t.forecast(s, d), k), weights_sql(_metric), "score weight")
register("e2_weighted_average", lambda s, d: _weighted(stored(s, d)), average_sql(weights_sql("crps_pinball")), COLS)
register("e3_median_ensemble", lambda s, d: e.median_ensemble(t.forecast(s, d)),
    f"SELECT uf, date, {', '.join(f'median({c}) AS {c}' for c in COLS)} FROM fx_forecast GROUP BY uf, date", COLS)
register("e4_stacking", lambda s, d: e.combine(t.forecast(s, d), "stacking"), average_sql(None), COLS)
register("e5_predict_clipped", lambda s, d: e.combine(t.forecast(s, d), "median"),
    "SELECT uf, date, " + ", ".join(f"greatest(median({c}), 0) AS {c}" if not c.startswith("upper") else f"median({c}) AS {c}" for c in COLS)
    + " FROM fx_forecast GROUP BY uf, date", COLS)


def corrections_sql(source: str, by: str = "uf", levels: list[int] = LEVELS) -> str:
    parts = [
        f"""(SELECT {by}, v0 + (v1 - v0) * (h - floor(h)) AS correction_{n} FROM
            (SELECT {by}, min(h) AS h, max(CASE WHEN rn = floor(h) + 1 THEN r END) AS v0, max(CASE WHEN rn = ceil(h) + 1 THEN r END) AS v1
             FROM (SELECT *, (n - 1) * least(ceil((n + 1) * {n} / 100.0::DOUBLE) / n, 0.999::DOUBLE) AS h FROM
                   (SELECT {by}, r, row_number() OVER (PARTITION BY {by} ORDER BY r) AS rn, count(*) OVER (PARTITION BY {by}) AS n FROM
                    (SELECT {by}, abs(lower_{n} - casos) AS r FROM {source} UNION ALL SELECT {by}, abs(casos - upper_{n}) FROM {source})))
             GROUP BY {by}))"""
        for n in levels
    ]
    text = parts[0] + " a0"
    for i, p in enumerate(parts[1:], 1):
        text += f" JOIN {p} a{i} USING ({by})"
    return f"SELECT {by}, {', '.join(f'correction_{n}' for n in levels)} FROM {text}"


CORR = [f"correction_{n}" for n in LEVELS]
register("e6_calibrate", lambda s, d: e.calibrate(stored(s, d).where(F.col("model") == "mean12")),
    corrections_sql("(SELECT * FROM fx_forecast WHERE model = 'mean12')"), CORR)
register("e6_calibrate_pooled", lambda s, d: e.calibrate(stored(s, d), by=("model",)), corrections_sql("fx_forecast", "model"), CORR)
register("e6_calibrate_standard", lambda s, d: e.calibrate(stored(s, d), by=("model",), levels=[80], standard=True),
    """SELECT model, v0 + (v1 - v0) * (h - floor(h)) AS correction_80 FROM
       (SELECT model, min(h) AS h, max(CASE WHEN rn = floor(h) + 1 THEN r END) AS v0, max(CASE WHEN rn = ceil(h) + 1 THEN r END) AS v1
        FROM (SELECT *, (n - 1) * least(ceil((n + 1) * 80 / 100.0::DOUBLE) / n, 0.999::DOUBLE) AS h FROM
              (SELECT model, greatest(lower_80 - casos, casos - upper_80) AS r,
                      row_number() OVER (PARTITION BY model ORDER BY greatest(lower_80 - casos, casos - upper_80)) AS rn,
                      count(*) OVER (PARTITION BY model) AS n FROM fx_forecast)) GROUP BY model)""", "correction_80")
register("e7_apply_calibration",
    lambda s, d: _applied(stored(s, d)),
    "SELECT f.uf, date, model, casos, median, lower_90, upper_90, " + ", ".join(
        f"lower_{n} - correction_{n} AS lower_{n}, upper_{n} + correction_{n} AS upper_{n}" for n in LEVELS)
    + f" FROM fx_forecast f JOIN ({corrections_sql('fx_forecast')}) c ON c.uf = f.uf", COLS)
register("e8_set_weights", lambda s, d: e.set_weights(e.fit_weights(t.forecast(s, d), "mae"), {"naive": 0.1, "unknown": 0.4}),
    f"""SELECT uf, model, score, w / sum(w) OVER (PARTITION BY uf) AS weight FROM
        (SELECT uf, model, score, CASE WHEN model = 'naive' THEN 0.1::DOUBLE ELSE weight END AS w FROM ({weights_sql('mae')}))""", "score weight")
register("e9_create_ensemble", lambda s, d: e.ensemble(t.forecast(s, d), None), average_sql(None, COLS3), COLS3)
register("e10_combine_given_weights", lambda s, d: _given(t.forecast(s, d)),
    average_sql("SELECT uf, model, CASE model WHEN 'naive' THEN 0.2::DOUBLE WHEN 'seasonal' THEN 0.3 END AS weight FROM fx_metrics", clip=False)
    + " HAVING bool_or(f.model <> 'mean12')", COLS)
register("e10_combine_strict", lambda s, d: e.weighted_average(_holes(t.forecast(s, d)), None, strict=True).select("uf", "date", "median"),
    """SELECT uf, date, CASE WHEN bool_or(model = 'naive' AND casos > 2) THEN NULL ELSE avg(median) END AS median
       FROM fx_forecast GROUP BY uf, date""", "median")
register("e10_combine_renormalized", lambda s, d: e.weighted_average(_holes(t.forecast(s, d)), None).select("uf", "date", "median"),
    "SELECT uf, date, avg(CASE WHEN model = 'naive' AND casos > 2 THEN NULL ELSE median END) AS median FROM fx_forecast GROUP BY uf, date", "median")
COMBINED = f"(SELECT c.*, o.casos FROM ({average_sql(weights_sql('crps_pinball'), COLS3)}) c JOIN fx_state o ON o.uf = c.uf AND o.date = c.date)"
register("e11_ensemble_flow", lambda s, d: e.ensemble(t.forecast(s, d), "casos"),
    "SELECT f.uf, date, median, " + ", ".join(f"lower_{n} - correction_{n} AS lower_{n}, upper_{n} + correction_{n} AS upper_{n}" for n in LEVELS)
    + f" FROM {COMBINED} f JOIN ({corrections_sql(COMBINED)}) c ON c.uf = f.uf", COLS3)
_AVG = average_sql(None)
_MED = "SELECT uf, date, " + ", ".join(
    f"greatest(median({c}), 0) AS {c}" if not c.startswith("upper") else f"median({c}) AS {c}" for c in COLS) + " FROM fx_forecast GROUP BY uf, date"
register("e12_compare_methods", lambda s, d: e.compare_methods(t.forecast(s, d)),
    f"""SELECT method, {t.score_sql(LEVELS)} FROM (SELECT 'weighted_average' AS method, * FROM ({_AVG}) UNION ALL SELECT 'median', * FROM ({_MED}))
        JOIN (SELECT uf, date, casos FROM fx_state) USING (uf, date) GROUP BY method""", t.SCORE_NAMES_3)
register("o6_weights_sorted", lambda s, d: e.fit_weights(t.forecast(s, d), "rmse").orderBy("uf", F.desc("weight"), "model"),
    weights_sql("rmse"), "score weight")


def _weighted(df):
    return e.combine(df, "weighted_average", e.fit_weights(df))


def _applied(df):
    return e.apply_calibration(df.drop("sd"), e.calibrate(df))


def _given(df):
    pairs = F.array(F.struct(F.lit("naive").alias("model"), F.lit(0.2).alias("weight")), F.struct(F.lit("seasonal").alias("model"), F.lit(0.3).alias("weight")))
    weights = df.select("uf").distinct().select("uf", F.inline(pairs))
    return e.weighted_average(df, weights).where(F.col("median").isNotNull())


def _holes(df):
    gone = (F.col("model") == "naive") & (F.col("casos") > 2)
    return df.withColumn("median", F.when(~gone, F.col("median")))
