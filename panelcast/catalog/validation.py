"""Backtests, model selection and what states learn from each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.prep import sparse
from panelcast.catalog.registry import register
from panelcast.plans import selection as v
from panelcast.plans.backtest import backtest_baselines, season_forecasts
from panelcast.session import cut_lineage

AVG = list(v.AVERAGED)


def stored(s, d):
    """Test scores, written once: selection reads them several times."""
    return cut_lineage(t.tests(s, d))


register("v1_backtest_baselines", lambda s, d: backtest_baselines(t.state(s, d), t.SEASONS), "SELECT * FROM fx_tests", t.SCORE_NAMES)
register("v1_backtest_forecasts", lambda s, d: season_forecasts(t.stored_state(s, d), [*t.SEASONS, t.FINAL]),
    f"SELECT uf, test, model, date, median, {t.BOUND_NAMES} FROM fx_ahead", f"median {t.BOUND_NAMES}".replace(",", ""))
register("v2_structure_by_model",
    lambda s, d: v.structure_by_model(t.tests(s, d)).select("uf", "model", F.explode("tests").alias("test", "e")).select("uf", "model", "test", "e.*"),
    "SELECT uf, model, test, crps, wis_total, rmse, mae FROM fx_tests", "crps wis_total rmse mae")
register("a11_average_over_tests", lambda s, d: v.average_over_tests(t.tests(s, d)),
    f"SELECT uf, model, {', '.join(f'avg({c}) AS {c}' for c in AVG)} FROM fx_tests GROUP BY uf, model", AVG)
register("a12_average_over_states", lambda s, d: v.average_over_tests(t.metrics(s, d), ("model",)),
    f"SELECT model, {', '.join(f'avg({c}) AS {c}' for c in AVG)} FROM fx_metrics GROUP BY model", AVG)

TABLE = f"""(SELECT uf, model, {', '.join(f'avg({c}) AS {c}' for c in AVG)}, count(DISTINCT test) AS n_tests,
    CASE WHEN count(crps) < 2 OR avg(crps) = 0 THEN 1 ELSE greatest(0, 1 - stddev_pop(crps) / avg(crps)) END AS consistency
    FROM fx_tests GROUP BY uf, model)"""
SCORE = """(0.35 * coalesce(crps, 1e6) + 0.25 * coalesce(wis_total, 1e6) + 0.20 * coalesce(mae, 1e6)
    + 0.15 * 1000 * abs(coalesce(coverage_95, 0.95) - 0.95) + 0.05 * abs(coalesce(bias, 0)) / 1000)"""
GOOD = "n_tests >= 3 AND coalesce(coverage_95, 0) >= 0.85 AND abs(coalesce(bias, 0)) <= 500"
SELECTED = f"""(SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY uf ORDER BY combined_score, model) AS INTEGER) AS rank FROM
    (SELECT *, {SCORE} AS performance_score, {SCORE} * (1 + (1 - consistency) * 0.2) AS combined_score FROM {TABLE} WHERE {GOOD})) WHERE rank <= 2)"""

register("v3_minimum_criteria", lambda s, d: v.qualifying_models(t.tests(s, d)).select("uf", "model"),
    f"SELECT uf, model FROM {TABLE} WHERE {GOOD}")
register("v4_composite_score", lambda s, d: v.average_over_tests(t.tests(s, d)).select("uf", "model", v.composite_score().alias("score")),
    f"SELECT uf, model, {SCORE} AS score FROM {TABLE}", "score")
register("v5_consistency", lambda s, d: v.consistency_score(t.tests(s, d)), f"SELECT uf, model, consistency FROM {TABLE}", "consistency")
register("v6_select_top_models", lambda s, d: v.select_top_models(t.tests(s, d), n_top=2),
    f"SELECT uf, model, rank, combined_score, performance_score, consistency FROM {SELECTED}", "combined_score performance_score consistency")
register("w13_rank_top_n", lambda s, d: v.top_per_group(t.metrics(s, d).select("uf", "model", "rmse"), ["uf"], [F.col("rmse"), F.col("model")], 2),
    """SELECT * FROM (SELECT uf, model, rmse, CAST(row_number() OVER (PARTITION BY uf ORDER BY rmse, model) AS INTEGER) AS rank FROM fx_metrics) WHERE rank <= 2""", "rmse")
register("r16_selection_report", lambda s, d: _report(stored(s, d)),
    "SELECT uf, model, rank, metric, avg(value) AS average, " + ", ".join(f"max(CASE WHEN test = '{k}' THEN value END) AS test_{k}" for k in "123")
    + f""" FROM (UNPIVOT (SELECT t.uf, t.model, s.rank, t.test, t.crps, t.wis_total, t.rmse, t.mae, t.mape, t.bias, t.coverage_95
        FROM fx_tests t JOIN {SELECTED} s ON s.uf = t.uf AND s.model = t.model)
        ON crps, wis_total, rmse, mae, mape, bias, coverage_95 INTO NAME metric VALUE value) GROUP BY uf, model, rank, metric""",
    "average test_1 test_2 test_3")

KB = "(0.5 * crps + 0.3 * wis_total + 0.2 * 1000 * (abs(coverage_95 - 0.95) + abs(coverage_50 - 0.5)))"
BEST = f"""(SELECT uf, model, score, test, params FROM (SELECT *, row_number() OVER (PARTITION BY uf, model ORDER BY score, test) AS rn
    FROM (SELECT *, {KB} AS score FROM fx_results)) WHERE rn = 1)"""
register("v7_best_parameters", lambda s, d: v.best_parameters(t.results(s, d)), f"SELECT * FROM {BEST}", "score")


def similar_sql(n: int, population: bool = False, proven: bool = False) -> str:
    score = """(CASE WHEN a.climate_zone = b.climate_zone THEN 0.3 ELSE 0 END + CASE WHEN a.biome = b.biome THEN 0.3 ELSE 0 END
        + CASE WHEN a.historical_pattern = b.historical_pattern THEN 0.2 ELSE 0 END"""
    if population:
        score += " + 0.2 * least(a.population, b.population) / greatest(a.population, b.population)"
    score += ")" + (" * CASE WHEN b.avg_cases > 1.95 THEN 1.2 ELSE 1 END" if proven else "")
    return f"""SELECT state_uf, similar_uf, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY state_uf ORDER BY round(score, 9) DESC, similar_uf) AS INTEGER) AS rank
        FROM (SELECT a.state_uf, b.state_uf AS similar_uf, CAST({score} AS DOUBLE) AS score FROM fx_profiles a JOIN fx_profiles b ON a.state_uf <> b.state_uf)) WHERE rank <= {n}"""


def profiles(s, d):
    return cut_lineage(t.profiles(s, d))


def _proven(df):
    return df.where(F.col("avg_cases") > 1.95).select("state_uf")


register("v8_similar_states", lambda s, d: v.similar_states(profiles(s, d)), similar_sql(3), "score")
register("v8_similar_states_proven", lambda s, d: _similar_proven(profiles(s, d)), similar_sql(3, proven=True), "score")
register("v8_similar_states_population",
    lambda s, d: v.similar_states(profiles(s, d), 4, ("climate", "biome", "population", "pattern")), similar_sql(4, population=True), "score")
register("j11_state_pairs_scored", lambda s, d: v.similar_states(profiles(s, d), 6), similar_sql(6), "score")
OFFER = f"""(SELECT m.state_uf AS uf, b.params, b.uf AS source_state, b.score, row_number() OVER (PARTITION BY m.state_uf ORDER BY b.score, b.uf) AS rn
    FROM ({similar_sql(3)}) m JOIN {BEST} b ON b.uf = m.similar_uf WHERE b.model = 'mean12')"""
register("v9_best_from_similar_states", lambda s, d: _from_similar(s, d),
    f"SELECT uf, params, source_state, score FROM {OFFER} WHERE rn = 1", "score")
register("o7_best_parameters_among_states",
    lambda s, d: v.best_parameters(t.results(s, d)).where(F.col("uf").isin("NATION_1", "NATION_4", "NATION_11") & (F.col("model") == "seasonal"))
        .orderBy("score", "uf").limit(1).select("uf", "params", "score"),
    f"SELECT uf, params, score FROM {BEST} WHERE uf IN ('NATION_1', 'NATION_4', 'NATION_11') AND model = 'seasonal' ORDER BY score, uf LIMIT 1", "score")
LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uf, model ORDER BY test DESC) AS rn FROM fx_tests) WHERE rn = 1)"""
register("v10_tuning_recommendations", lambda s, d: _recommend(s, d),
    f"""SELECT l.uf, l.model, coverage_95 < 0.90 AS coverage_issue, coverage_50 < 0.45 OR coverage_50 > 0.55 AS calibration_issue,
        CASE WHEN bias > 100 THEN 'overestimating' WHEN bias < -100 THEN 'underestimating' END AS bias_issue,
        coalesce(n_improved, 0) AS n_improved, max_improvement FROM {LATEST} l LEFT JOIN
        (SELECT m.state_uf AS uf, p.model, count(*) AS n_improved, max(p.gain) AS max_improvement FROM ({similar_sql(3)}) m
         JOIN (SELECT uf, model, max(CASE WHEN test = '1' THEN crps END) - max(CASE WHEN test = '3' THEN crps END) AS gain FROM fx_tests GROUP BY uf, model) p
         ON p.uf = m.similar_uf WHERE p.gain > 0 GROUP BY 1, 2) g ON g.uf = l.uf AND g.model = l.model""", "max_improvement")

BOOSTS = [(("NATION_0", "NATION_5", "NATION_7"), {"prophet": 0.1, "nbeats": 0.05}), (("NATION_5", "NATION_9"), {"tft": 0.1, "lstm": 0.05}),
          (("NATION_3",), {"prophet": 0.1, "lstm": -0.1, "tft": -0.05})]
FAMILIES = """(SELECT p.*, m.model, m.base + CASE WHEN uf IN ('NATION_0', 'NATION_5', 'NATION_7') AND m.model = 'prophet' THEN 0.1
      WHEN uf IN ('NATION_0', 'NATION_5', 'NATION_7') AND m.model = 'nbeats' THEN 0.05 ELSE 0 END
    + CASE WHEN uf IN ('NATION_5', 'NATION_9') AND m.model = 'tft' THEN 0.1 WHEN uf IN ('NATION_5', 'NATION_9') AND m.model = 'lstm' THEN 0.05 ELSE 0 END
    + CASE WHEN uf = 'NATION_3' AND m.model = 'prophet' THEN 0.1 WHEN uf = 'NATION_3' AND m.model = 'lstm' THEN -0.1
      WHEN uf = 'NATION_3' AND m.model = 'tft' THEN -0.05 ELSE 0 END AS base_score
    FROM (SELECT uf, count(*) AS data_size, count(DISTINCT casos) AS n_features, bool_or(temp_med IS NULL) AS has_missing FROM fx_panel GROUP BY uf) p,
    (VALUES ('xgboost', 0.85::DOUBLE), ('prophet', 0.75), ('tft', 0.70), ('nbeats', 0.65), ('lstm', 0.60)) AS m(model, base))"""
ADJUSTED = """base_score * CASE WHEN data_size < 300 AND model IN ('lstm', 'tft') THEN 0.7 WHEN data_size < 300 AND model = 'prophet' THEN 1.1 ELSE 1 END
    * CASE WHEN data_size > 1000 AND model IN ('lstm', 'tft') THEN 1.1 ELSE 1 END
    * CASE WHEN n_features > 20 AND model = 'xgboost' THEN 1.15 WHEN n_features > 20 AND model = 'tft' THEN 1.1 ELSE 1 END
    * CASE WHEN has_missing AND model = 'xgboost' THEN 1.1 WHEN has_missing AND model = 'prophet' THEN 1.05 ELSE 1 END"""
PICK = """SELECT uf, model, CAST(score AS DOUBLE) AS score, priority, upper(model) || ': ' || CASE WHEN len(parts) > 0 THEN array_to_string(parts, ', ') ELSE 'general purpose model' END AS reasoning
    FROM (SELECT *, list_filter([CASE WHEN score > 0.8 THEN 'High historical performance in ' || uf WHEN score > 0.6 THEN 'Good match for ' || uf || '''s characteristics' END,
      CASE WHEN list_contains(strengths, 'seasonality') THEN 'handles seasonality well' END,
      CASE WHEN list_contains(strengths, 'trend') OR list_contains(strengths, 'trend_decomposition') THEN 'captures trend patterns' END,
      CASE WHEN list_contains(strengths, 'interpretability') THEN 'highly interpretable' END], lambda x: x IS NOT NULL) AS parts FROM
     (SELECT *, CAST(row_number() OVER (PARTITION BY uf ORDER BY round(score, 9) DESC, model) AS INTEGER) AS priority FROM ({0})) JOIN
     (VALUES ('xgboost', ['seasonality', 'trend', 'feature_importance']), ('lstm', ['long_term_patterns', 'complex_dynamics']),
      ('prophet', ['seasonality', 'trend_changepoints', 'holidays']), ('tft', ['attention', 'interpretability', 'variable_selection']),
      ('nbeats', ['trend_decomposition', 'seasonality'])) AS k(model, strengths) USING (model)) WHERE priority <= 3"""
register("v11_preselect_models", lambda s, d: v.preselect_models(_data_profile(s, d), boosts=BOOSTS),
    PICK.replace("{0}", f"SELECT uf, model, {ADJUSTED} AS score FROM {FAMILIES}"), "score")
HISTORY = """(SELECT uf, CASE model WHEN 'naive' THEN 'xgboost' WHEN 'seasonal' THEN 'prophet' ELSE 'lstm' END AS model,
    (0.5 + coalesce(sum(1 / (1 + crps / 100)) FILTER (crps > 0), 0)) / (count(*) FILTER (crps > 0) + 1) AS score FROM fx_tests GROUP BY 1, 2)"""
register("v12_history_score", lambda s, d: v.history_scores(_renamed(t.tests(s, d))), f"SELECT * FROM {HISTORY}", "score")
register("v12_preselect_by_history",
    lambda s, d: v.preselect_models(_data_profile(s, d), history=v.history_scores(_renamed(t.tests(s, d)))),
    PICK.replace("{0}", f"""SELECT f.uf, f.model, {ADJUSTED} AS score FROM
        (SELECT f.* REPLACE (coalesce(h.score, 0.5) AS base_score) FROM {FAMILIES} f LEFT JOIN {HISTORY} h ON h.uf = f.uf AND h.model = f.model) f"""), "score")
register("v13_best_over_tests", lambda s, d: v.best_over_tests(t.results(s, d)),
    """SELECT uf, model, params, test FROM (SELECT *, row_number() OVER (PARTITION BY uf, model ORDER BY test) AS rn FROM fx_results WHERE params <> '') WHERE rn = 1""")
register("q13_focus_areas", lambda s, d: v.focus_areas(t.tests(s, d)),
    f"""SELECT uf, model, list_sort(CASE WHEN len(found) > 0 THEN found ELSE ['learning_rate', 'n_estimators'] END) AS focus FROM
        (SELECT uf, model, list_concat(CASE WHEN coverage_95 < 0.9 THEN ['subsample', 'colsample_bytree'] ELSE [] END,
         CASE WHEN abs(bias) > 100 THEN ['learning_rate', 'gamma'] ELSE [] END, CASE WHEN mape > 50 THEN ['max_depth', 'min_child_weight'] ELSE [] END) AS found FROM {LATEST})""")
register("q15_suggest_parameters", lambda s, d: v.suggest_parameters(_rounds(s, d)),
    """SELECT uf, model, rmse, mae, coverage_95, CAST(6 AS INTEGER) AS max_depth, 0.05::DOUBLE AS learning_rate, 0.8::DOUBLE AS subsample,
       CAST(CASE WHEN rmse > 2 * mae THEN 7 ELSE 6 END AS INTEGER) AS next_max_depth, CASE WHEN rmse > 2 * mae THEN 0.045::DOUBLE ELSE 0.05 END AS next_learning_rate,
       CASE WHEN coverage_95 < 0.85 THEN 0.7::DOUBLE ELSE 0.8 END AS next_subsample FROM fx_metrics""",
    "rmse mae coverage_95 learning_rate subsample next_learning_rate next_subsample")
register("q15_suggest_network_parameters",
    lambda s, d: v.suggest_parameters(t.metrics(s, d).select("uf", "model", "rmse", "mae", "coverage_95",
        F.when(F.col("model") != "naive", 128).alias("hidden_size"), F.when(F.col("model") != "naive", 2).alias("num_layers")), "lstm"),
    """SELECT uf, model, rmse, mae, coverage_95, CAST(CASE WHEN model <> 'naive' THEN 128 END AS INTEGER) AS hidden_size,
       CAST(CASE WHEN model <> 'naive' THEN 2 END AS INTEGER) AS num_layers,
       CAST(CASE WHEN model <> 'naive' AND rmse > 2 * mae THEN 256 ELSE 128 END AS INTEGER) AS next_hidden_size,
       CAST(CASE WHEN model <> 'naive' AND rmse > 2 * mae THEN 3 ELSE 2 END AS INTEGER) AS next_num_layers FROM fx_metrics""", "rmse mae coverage_95")
register("a14_zone_insights", lambda s, d: v.zone_insights(t.tests(s, d), profiles(s, d)),
    """SELECT climate_zone, min_by(uf, crps) AS best_state, min(crps) AS best_crps, avg(crps) AS avg_crps FROM
       (SELECT uf, avg(crps) AS crps FROM fx_tests GROUP BY uf) JOIN fx_profiles ON state_uf = uf GROUP BY climate_zone""", "best_crps avg_crps")
register("u3_models_over_tests", lambda s, d: t.tests(s, d).select("model").distinct(), "SELECT DISTINCT model FROM fx_tests")


def _report(tests):
    return v.selection_report(tests, v.select_top_models(tests, n_top=2))


def _similar_proven(df):
    return v.similar_states(df, 3, proven=_proven(df))


def _from_similar(s, d):
    similar_uf = v.similar_states(profiles(s, d), 3).select(F.col("state_uf").alias("uf"), "similar_uf")
    return v.best_from_states(v.best_parameters(t.results(s, d)), similar_uf, "mean12")


def _recommend(s, d):
    return v.tuning_recommendations(stored(s, d), v.similar_states(profiles(s, d), 3))


def _data_profile(s, d):
    return sparse(s, d).groupBy("uf").agg(
        F.count(F.lit(1)).alias("data_size"), F.count_distinct("casos").alias("n_features"), F.bool_or(F.col("temp_med").isNull()).alias("has_missing")
    )


def _renamed(df):
    name = F.when(F.col("model") == "naive", "xgboost").when(F.col("model") == "seasonal", "prophet").otherwise("lstm")
    return df.withColumn("model", name)


def _rounds(s, d):
    return t.metrics(s, d).select("uf", "model", "rmse", "mae", "coverage_95", F.lit(6).alias("max_depth"), F.lit(0.05).alias("learning_rate"), F.lit(0.8).alias("subsample"))
