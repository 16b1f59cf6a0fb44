"""Submission documents and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.registry import register
from panelcast.operators.forecasts import gaussian_from_interval
from panelcast.operators.scores import ALL_LEVELS
from panelcast.plans import submission as sub
from panelcast.session import cut_lineage

BOUNDS = [c for n in ALL_LEVELS for c in (f"lower_{n}", f"upper_{n}")]
COLS = ["median", *BOUNDS]
META = {"model_id": 7, "predict_date": "2001-08-05"}


def one_model(s, d):
    return t.forecast(s, d).where(F.col("model") == "mean12").select("uf", "date", *COLS)


def rows_sql(source: str = "fx_forecast", uf: str = "uf", extra: str = "") -> str:
    return f"""SELECT strftime(date, '%Y-%m-%d') AS date, 'BRA' AS adm_0, {uf} AS adm_1, {', '.join(f'greatest({c}, 0) AS {c}' for c in COLS)}
        FROM {source} {extra}"""


STATE_ROWS = rows_sql(extra="WHERE model = 'mean12'")
NATIONAL = f"(SELECT date, {', '.join(f'sum({c}) AS {c}' for c in COLS)} FROM fx_forecast WHERE model = 'mean12' GROUP BY date)"

register("b1_format_state_forecast",
    lambda s, d: sub.format_forecasts(one_model(s, d), **META).select(
        "model", "description", "commit", "predict_date", "adm_0", "adm_1", "adm_2", "adm_3", F.size("prediction.dates").alias("n"),
        F.element_at("prediction.dates", 1).alias("first_date"), F.element_at("prediction.preds", -1).alias("last_pred")),
    """SELECT CAST(7 AS INTEGER) AS model, 'Forecast for ' || uf AS description, CAST(NULL AS VARCHAR) AS "commit", '2001-08-05' AS predict_date, 'BRA' AS adm_0,
       uf AS adm_1, CAST(NULL AS INTEGER) AS adm_2, CAST(NULL AS INTEGER) AS adm_3, CAST(count(*) AS INTEGER) AS n,
       strftime(min(date), '%Y-%m-%d') AS first_date, max_by(greatest(median, 0), date) AS last_pred FROM fx_forecast WHERE model = 'mean12' GROUP BY uf""", "last_pred")
register("b2_national_forecast", lambda s, d: sub.to_rows(sub.format_forecasts(sub.national_total(one_model(s, d)), (), **META)),
    rows_sql(NATIONAL, "'BR'"), COLS)
register("b3_format_all", lambda s, d: _all(cut_lineage(one_model(s, d))), f"{STATE_ROWS} UNION ALL {rows_sql(NATIONAL, chr(39) + 'BR' + chr(39))}", COLS)
register("b4_to_rows", lambda s, d: sub.to_rows(sub.format_forecasts(one_model(s, d), **META)), STATE_ROWS, COLS)
register("b5_validate_documents", lambda s, d: sub.validate_documents(_crossing(s, d)),
    """SELECT uf AS adm_1, 'lower_50 > upper_50' AS issue, i AS "index" FROM
       (SELECT uf, CAST(row_number() OVER (PARTITION BY uf ORDER BY date) - 1 AS INTEGER) AS i, greatest(upper_50 - 1, 0) AS lo, greatest(median, 0) AS hi
        FROM fx_forecast WHERE model = 'mean12') WHERE lo > hi""")
register("b6_table_from_arrays", lambda s, d: _from_arrays(s, d),
    f"SELECT uf, date, {', '.join(COLS[:3])} FROM fx_forecast WHERE model = 'mean12'", COLS[:3])
register("b7_required_columns", lambda s, d: _required(one_model(s, d)), "SELECT uf, date, median FROM fx_forecast WHERE model = 'mean12'", "median")
register("b8_plausibility",
    lambda s, d: sub.plausibility_issues(gaussian_from_interval(t.forecast(s, d).select("uf", "date", "model", "median", "lower_80", "upper_80", "casos")), "casos", ("uf", "date", "model")),
    " UNION ALL ".join(
        f"""SELECT uf, date, model, 'lower_{n} negative' AS issue FROM fx_forecast WHERE median - {z} * ((upper_80 - lower_80) / (2 * 1.28)) < 0"""
        for n, z in ((50, 0.67449), (80, 1.28155), (90, 1.64485), (95, 1.95996)))
    + " UNION ALL SELECT uf, date, model, 'median above population' FROM fx_forecast WHERE median > casos")
register("f14_iso_dates", lambda s, d: t.state(s, d).select("uf", F.date_format("date", "yyyy-MM-dd").alias("date")),
    "SELECT uf, strftime(date, '%Y-%m-%d') AS date FROM fx_state")


def _all(df):
    return sub.to_rows(sub.format_all(df, sub.national_total(df), **META))


def _crossing(s, d):
    df = t.forecast(s, d).where(F.col("model") == "mean12")
    return sub.format_forecasts(df.select("uf", "date", "median", (F.col("upper_50") - 1).alias("lower_50"), F.col("median").alias("upper_50")), **META)


def _from_arrays(s, d):
    p = "prediction"
    docs = sub.format_forecasts(one_model(s, d).select("uf", "date", *COLS[:3]), **META)
    return sub.documents_from_arrays(docs.select(F.col("adm_1").alias("uf"), f"{p}.dates", F.col(f"{p}.preds").alias("median"), f"{p}.lower_50", f"{p}.upper_50"))


def _required(df):
    sub.require_columns(df)
    return df.select("uf", *sub.REQUIRED)
