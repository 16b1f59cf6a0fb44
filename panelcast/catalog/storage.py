"""Sources and sinks: tables derived from the data are written out and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.ensembles import CORR, corrections_sql, weights_sql
from panelcast.catalog.registry import register
from panelcast.catalog.validation import SELECTED
from panelcast.functions.reference import SOURCE_FILES
from panelcast.operators import ensemble as e
from panelcast.operators.features import lag_features
from panelcast.operators.scores import ALL_LEVELS, LEVELS
from panelcast.plans import selection as v
from panelcast.plans import submission as sub
from panelcast.session import cut_lineage, scratch_path
from panelcast.sources import readers, sinks

COLS = ["median"] + [c for n in ALL_LEVELS for c in (f"lower_{n}", f"upper_{n}")]
FILE = {name: file for name, file, _ in SOURCE_FILES}


def _as_csv(df, folder, name):
    """Store a table under its raw file name, as (possibly compressed) CSV parts."""
    writer = df.write.option("header", True)
    (writer.option("compression", "gzip") if FILE[name].endswith(".gz") else writer).csv(f"{folder}/{FILE[name]}")


def _scan(name, build, *casts):
    def run(s, d):
        folder = scratch_path(s, "raw")
        _as_csv(build(s, d), folder, name)
        return readers.read_table(s, folder, name)

    return run


FLAGS = ", ".join(f"{r}_{i}" for r in ("train", "target") for i in (1, 2, 3))
register("s1_scan_dengue",
    _scan("dengue", lambda s, d: t.flagged(s, d).withColumn("casos", F.when(F.col("casos") > 1, F.col("casos")))),
    f"SELECT date, geocode, uf, epiweek, CASE WHEN casos > 1 THEN casos ELSE 0 END AS casos, {FLAGS} FROM fx_flagged")
register("s2_scan_climate", _scan("climate", t.climate), "SELECT * FROM fx_climate", "temp_min temp_med temp_max precip_tot rel_humid_med")
register("s3_scan_climate_forecast", _scan("climate_forecast", lambda s, d: t.climate(s, d).select(F.trunc("date", "month").alias("reference_month"), "geocode").distinct()),
    "SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS reference_month, geocode FROM fx_climate")
register("s4_scan_population", _scan("population", t.population), "SELECT * FROM fx_population")
register("s5_scan_environ", _scan("environ", t.environ), "SELECT * FROM fx_environ")
register("s6_scan_ocean", _scan("ocean", t.ocean), "SELECT * FROM fx_ocean", "enso iod pdo")
register("s7_scan_regional_map", _scan("regional_map", lambda s, d: t.dengue(s, d).select("geocode", "uf").distinct()),
    "SELECT DISTINCT geocode, uf FROM fx_dengue")
register("s9_source_inventory", lambda s, d: _inventory(s, d),
    """SELECT "table" || '.parquet' AS file, "table", required, n IS NOT NULL AS present, coalesce(n, 0) > 0 AS has_bytes, coalesce(n, 0) AS n_rows
       FROM (VALUES ('orders', true), ('customer', true), ('shapes', false)) AS v("table", required)
       LEFT JOIN (SELECT 'orders' AS "table", count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer) USING ("table")""")
register("s10_forecasts_round_trip", lambda s, d: _forecasts(s, d, "csv"), f"SELECT uf, date, model, {', '.join(COLS)} FROM fx_forecast", COLS)
register("s10_forecasts_parquet", lambda s, d: _forecasts(s, d, "parquet"), f"SELECT uf, date, model, {', '.join(COLS)} FROM fx_forecast", COLS)
register("s11_ensemble_round_trip", lambda s, d: _ensemble(s, d), f"SELECT uf, date, model, {', '.join(COLS)} FROM fx_forecast", COLS)
register("s11_saved_weights", lambda s, d: _saved(s, d)["weights"].select("uf", "model", "score", "weight"), weights_sql("crps_pinball"), "score weight")
register("s11_saved_corrections", lambda s, d: _saved(s, d)["corrections"], corrections_sql("fx_forecast", "model"), CORR)
SCORES = [c.split()[0] for c in sinks.SCORES.split(", ")]
register("s12_validation_round_trip", lambda s, d: _validation(s, d), f"SELECT uf, test, model, {', '.join(SCORES)} FROM fx_tests", SCORES)
register("s12_saved_top_models", lambda s, d: _top_models(s, d),
    f"SELECT uf, CAST(rank AS INTEGER) AS rank, model, combined_score FROM {SELECTED.replace('rank <= 2', 'rank <= 3')}", "combined_score")
register("s13_metrics_csv", lambda s, d: _metrics(s, d), "SELECT * FROM fx_metrics", t.SCORE_NAMES)
register("s14_knowledge_round_trip", lambda s, d: _knowledge(s, d),
    """SELECT uf, model, params, test FROM (SELECT *, row_number() OVER (PARTITION BY uf, model ORDER BY 0.5 * crps + 0.3 * wis_total
       + 0.2 * 1000 * (abs(coverage_95 - 0.95) + abs(coverage_50 - 0.5)), test) AS rn FROM fx_results) WHERE rn = 1""")
register("s15_feature_cache", lambda s, d: _cached(s, d),
    "SELECT uf, date, casos, lag(casos, 1) OVER w AS casos_lag_1, lag(casos, 4) OVER w AS casos_lag_4 FROM fx_state WINDOW w AS (PARTITION BY uf ORDER BY date)")
register("s16_submission_files", lambda s, d: _submissions(s, d),
    f"SELECT uf AS adm_1, date, {', '.join(f'greatest({c}, 0) AS {c}' for c in COLS)} FROM fx_forecast WHERE model = 'mean12'", COLS)
register("s16_submission_json", lambda s, d: _submission_json(s, d),
    "SELECT uf AS folder, 'Forecast for ' || uf AS description, CAST(count(*) AS INTEGER) AS n FROM fx_forecast WHERE model = 'mean12' GROUP BY uf")
register("f15_json_documents",
    lambda s, d: t.metrics(s, d).select("uf", "model", F.get_json_object(F.to_json(F.struct("uf", "model", F.struct(F.round("rmse", 3).alias("rmse")).alias("scores"))), "$.scores.rmse").cast("double").alias("rmse")),
    "SELECT uf, model, round(rmse, 3) AS rmse FROM fx_metrics")
register("f17_data_key",
    lambda s, d: sinks.data_key(t.state(s, d)).select("n", F.length(F.sha2(F.col("h").cast("string"), 256)).alias("digits")),
    "SELECT count(*) AS n, CAST(64 AS INTEGER) AS digits FROM fx_state")
register("f17_md5_keys", lambda s, d: t.state(s, d).select("uf", "date", F.md5(F.concat_ws("|", "uf", "date", "casos")).alias("key")),
    "SELECT uf, date, md5(uf || '|' || strftime(date, '%Y-%m-%d') || '|' || casos) AS key FROM fx_state")


def _inventory(s, d):
    expected = [("orders", "orders.parquet", True), ("customer", "customer.parquet", True), ("shapes", "shapes.parquet", False)]
    found = readers.source_inventory(s, d, expected).select("file", "table", "required", "present", (F.col("bytes") > 0).alias("has_bytes"))
    counts = [t.table(s, d, name).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table", F.lit(name)) for name in ("orders", "customer")]
    return found.join(counts[0].unionByName(counts[1]), "table", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def _forecasts(s, d, fmt):
    path = scratch_path(s, "forecasts")
    sinks.write_forecasts(t.forecast(s, d).select("uf", "date", "model", *COLS), path, fmt)
    schema = "date date, " + ", ".join(f"{c} double" for c in COLS) + ", uf string, model string"
    return sinks.read_forecasts(s, path, schema, fmt)


def _saved(s, d):
    """An ensemble's forecasts, weights and corrections, written and read back."""
    path = scratch_path(s, "ensemble")
    df = cut_lineage(t.forecast(s, d).drop("sd"))
    weights = e.fit_weights(df)
    sinks.save_ensemble(path, df, weights, e.calibrate(df, ("model",), levels=LEVELS))
    return sinks.load_ensemble(s, path)


def _ensemble(s, d):
    saved = _saved(s, d)
    # only what the saved weights and corrections know
    return (
        saved["forecasts"].join(saved["weights"].select("uf", "model"), ["uf", "model"], "left_semi")
        .join(saved["corrections"], "model", "left_semi").select("uf", "date", "model", *COLS)
    )


def _validation_files(s, d):
    path = scratch_path(s, "validation")
    tests = cut_lineage(t.tests(s, d))
    sinks.write_validation(sinks.validation_documents(tests, v.select_top_models(tests)), path)
    return path


def _validation(s, d):
    return sinks.read_validation(s, _validation_files(s, d))


def _top_models(s, d):
    """The ranked models as the documents hold them."""
    documents = s.read.schema(sinks.RESULT_SCHEMA).json(_validation_files(s, d))
    models = documents.select("uf", F.posexplode("top_models").alias("rank", "m"))
    return models.select("uf", (F.col("rank") + 1).alias("rank"), F.col("m.model_name").alias("model"), F.col("m.combined_score").alias("combined_score"))


def _metrics(s, d):
    path = scratch_path(s, "metrics")
    sinks.write_metrics(t.metrics(s, d), path)
    return s.read.schema("uf string, model string, " + ", ".join(f"{c} double" for c in t.SCORE_NAMES)).csv(path, header=True)


def _knowledge(s, d):
    path = scratch_path(s, "knowledge")
    results = cut_lineage(t.results(s, d))
    sinks.save_knowledge(path, results, v.best_parameters(results))
    return sinks.load_knowledge(s, path)[1].select("uf", "model", "params", "test")


def _cached(s, d):
    cache = sinks.FeatureCache(s, scratch_path(s, "cache"))
    df = cut_lineage(t.state(s, d).select("uf", "date", "casos"))
    config = {"lags": [1, 4]}
    cache.get_or_compute(df, lambda x: lag_features(x, lags=[1, 4]), config)
    return cache.get_or_compute(df, lambda x: lag_features(x, lags=[1, 4]), config)


def _documents(s, d):
    df = t.forecast(s, d).where(F.col("model") == "mean12").select("uf", "date", *COLS)
    return sub.format_forecasts(df, model_id=7, predict_date="2001-08-05")


def _submissions(s, d):
    path = scratch_path(s, "submissions")
    sinks.write_submissions(_documents(s, d), path, "csv")
    schema = "date date, adm_0 string, adm_1 string, " + ", ".join(f"{c} double" for c in COLS)
    return s.read.schema(schema).csv(path, header=True).select("adm_1", "date", *COLS)


def _submission_json(s, d):
    path = scratch_path(s, "submissions")
    docs = _documents(s, d)
    sinks.write_submissions(docs, path, "json")
    back = s.read.schema(docs.schema.add("folder", "string")).json(path)
    return back.select("folder", "description", F.size("prediction.dates").alias("n"))
