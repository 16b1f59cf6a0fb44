"""Calendar, lag, rolling, climate, spatial and ocean features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.panel import panel
from panelcast.catalog.prep import capped_sql, seasonal_sql
from panelcast.catalog.registry import register
from panelcast.functions.scalar import cycle, season
from panelcast.operators import features as ft
from panelcast.plans.prepare import build_feature_set, prepare_states
from panelcast.series import Series
from panelcast.session import cut_lineage

W = "WINDOW w AS (PARTITION BY uf ORDER BY date)"
PLACE = Series(key=("geocode",))


def lags_sql(y: str = "casos", lags=ft.LAGS) -> list[str]:
    return [f"lag({y}, {k}) OVER w AS {y}_lag_{k}" for k in lags]


def rolling_sql(y: str = "casos", windows=ft.WINDOWS, stats=ft.STATS, key: str = "uf") -> list[str]:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}
    return [
        f"{fn[s]}({y}) OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {y}_roll_{s}_{n}"
        for n in windows for s in stats
    ]


def rolling_doubles(y: str = "casos", windows=ft.WINDOWS, stats=ft.STATS) -> list[str]:
    return [f"{y}_roll_{s}_{n}" for n in windows for s in stats if s in ("mean", "std", "median")]


def diffs_sql(y: str = "casos", periods=ft.DIFF_PERIODS) -> list[str]:
    out = []
    for k in periods:
        out.append(f"{y} - lag({y}, {k}) OVER w AS {y}_diff_{k}")
        out.append(f"({y} - lag({y}, {k}) OVER w) / nullif(CAST(lag({y}, {k}) OVER w AS DOUBLE), 0) AS {y}_pct_change_{k}")
    return out


DIFF_DOUBLES = [f"casos_pct_change_{k}" for k in ft.DIFF_PERIODS]
HORIZONS = [f"lead(casos, {h}) OVER w AS casos_horizon_{h}" for h in range(1, 5)]
TIME = """CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year,
    CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(quarter(date) AS INTEGER) AS quarter,
    sin(2 * pi() * weekofyear(date) / 52) AS week_sin, cos(2 * pi() * weekofyear(date) / 52) AS week_cos,
    sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
    CASE WHEN month(date) IN (12, 1, 2) THEN 'summer' WHEN month(date) IN (3, 4, 5) THEN 'autumn'
         WHEN month(date) IN (6, 7, 8) THEN 'winter' ELSE 'spring' END AS season,
    CAST(month(date) IN (1, 2, 3, 4, 5) AS INTEGER) AS is_dengue_season"""
TIME_DOUBLES = "week_sin week_cos month_sin month_cos"
_T, _R = "(temp_med * 9 / 5 + 32)", "rel_humid_med"
HEAT = f"""((-42.379::DOUBLE + 2.04901523 * {_T} + 10.14333127 * {_R} - 0.22475541 * {_T} * {_R} - 0.00683783 * {_T} * {_T}
    - 0.05481717 * {_R} * {_R} + 0.00122874 * {_T} * {_T} * {_R} + 0.00085282 * {_T} * {_R} * {_R}
    - 0.00000199 * {_T} * {_T} * {_R} * {_R}) - 32) * 5 / 9"""
CLIMATE = f"""{HEAT} AS heat_index, temp_max - temp_min AS temp_range, temp_med * precip_tot AS temp_precip_interaction,
    rel_humid_med * precip_tot AS humidity_precip_interaction, temp_med * temp_med AS temp_squared"""
CLIMATE_DOUBLES = "heat_index temp_range temp_precip_interaction humidity_precip_interaction temp_squared"
PANEL_DOUBLES = "temp_min temp_med temp_max precip_tot rel_humid_med"
SPATIAL = """(SELECT e.uf, s.date, avg(s.casos) AS casos_spatial_lag FROM fx_edges e JOIN fx_state s ON s.uf = e.neighbor GROUP BY e.uf, s.date)"""


def _state(s, d):
    return t.stored_state(s, d).select("uf", "date", "casos")


def _rolled(s, d):
    return t.state(s, d).select("uf", "date", "casos")


def _places(s, d):
    return cut_lineage(t.dengue(s, d).select("geocode", "date", "casos"))


register("f1_time_features", lambda s, d: ft.time_features(_rolled(s, d)).drop(*TIME_DOUBLES.split(), "season", "is_dengue_season"),
    f"SELECT * EXCLUDE (week_sin, week_cos, month_sin, month_cos, season, is_dengue_season) FROM (SELECT uf, date, casos, {TIME} FROM fx_state)")
register("f2_cyclical_encoding",
    lambda s, d: _rolled(s, d).select("uf", "date", cycle(F.weekofyear("date"), 52)[0].alias("week_sin"), cycle(F.weekofyear("date"), 52)[1].alias("week_cos"),
        cycle(F.month("date"), 12)[0].alias("month_sin"), cycle(F.month("date"), 12)[1].alias("month_cos")),
    f"SELECT uf, date, week_sin, week_cos, month_sin, month_cos FROM (SELECT uf, date, {TIME} FROM fx_state)", TIME_DOUBLES)
register("f3_season", lambda s, d: _rolled(s, d).groupBy(season(F.month("date")).alias("season")).agg(F.sum("casos").alias("casos")),
    f"SELECT season, CAST(sum(casos) AS BIGINT) AS casos FROM (SELECT casos, {TIME} FROM fx_state) GROUP BY season")
register("f4_peak_season", lambda s, d: ft.time_features(_rolled(s, d)).select("uf", "date", "is_dengue_season"),
    f"SELECT uf, date, is_dengue_season FROM (SELECT uf, date, {TIME} FROM fx_state)")
register("f5_heat_index", lambda s, d: ft.climate_features(t.climate(s, d)).select("date", "geocode", "heat_index"),
    f"SELECT date, geocode, {HEAT} AS heat_index FROM fx_climate", "heat_index")
register("f6_climate_interactions", lambda s, d: ft.climate_features(t.climate(s, d)),
    f"SELECT *, {CLIMATE} FROM fx_climate", f"{PANEL_DOUBLES} {CLIMATE_DOUBLES}")
register("w1_lag_features", lambda s, d: ft.lag_features(_state(s, d)),
    f"SELECT uf, date, casos, {', '.join(lags_sql())} FROM fx_state {W}")
register("w1_lag_features_by_place", lambda s, d: ft.lag_features(_places(s, d), lags=[1, 2, 52], s=Series(key=("geocode",), chunk_rows=64)),
    f"SELECT geocode, date, casos, {', '.join(lags_sql(lags=[1, 2, 52]))} FROM fx_dengue WINDOW w AS (PARTITION BY geocode ORDER BY date)")
register("w2_rolling_features", lambda s, d: ft.rolling_features(_state(s, d), stats=[*ft.STATS, "median"]),
    f"SELECT uf, date, casos, {', '.join(rolling_sql(stats=[*ft.STATS, 'median']))} FROM fx_state",
    rolling_doubles(stats=[*ft.STATS, "median"]))
register("w2_rolling_by_place", lambda s, d: ft.rolling_features(_places(s, d), windows=[4, 12], s=PLACE),
    f"SELECT geocode, date, casos, {', '.join(rolling_sql(windows=[4, 12], key='geocode'))} FROM fx_dengue",
    rolling_doubles(windows=[4, 12]))
register("w3_diff_features", lambda s, d: ft.diff_features(_state(s, d)).drop(*DIFF_DOUBLES),
    f"SELECT uf, date, casos, {', '.join(x for x in diffs_sql() if 'pct' not in x)} FROM fx_state {W}")
register("w4_pct_change", lambda s, d: ft.diff_features(_state(s, d)).select("uf", "date", *DIFF_DOUBLES),
    f"SELECT uf, date, {', '.join(x for x in diffs_sql() if 'pct' in x)} FROM fx_state {W}", DIFF_DOUBLES)
register("w5_horizon_targets", lambda s, d: ft.horizon_targets(_state(s, d)),
    f"SELECT uf, date, casos, {', '.join(HORIZONS)} FROM fx_state {W}")
register("j5_join_ocean_exact", lambda s, d: ft.attach(_rolled(s, d), t.ocean(s, d), ["date"], ["uf"]),
    "SELECT uf, date, casos, enso, iod, pdo FROM fx_state LEFT JOIN fx_ocean USING (date)", "enso iod pdo")
register("w6_ocean_lags", lambda s, d: ft.ocean_exact(_state(s, d), t.ocean(s, d)),
    f"""SELECT uf, date, casos, enso, iod, pdo, {', '.join(f'lag({c}, {k}) OVER w AS {c}_lag{k}' for c in ft.OCEAN for k in (4, 8))}
        FROM fx_state LEFT JOIN fx_ocean USING (date) {W}""", "enso iod pdo enso_lag4 enso_lag8 iod_lag4 iod_lag8 pdo_lag4 pdo_lag8")
ASOF_NAMES = [c if k == 0 else f"{c}_lag{k}" for k in (0, 4, 8, 12) for c in ft.OCEAN]
register("j5b_join_ocean_asof", lambda s, d: ft.ocean_asof(_state(s, d), t.ocean(s, d)),
    "SELECT uf, p.date, casos, " + ", ".join(f"o{k}.{c} AS {c if k == 0 else f'{c}_lag{k}'}" for k in (0, 4, 8, 12) for c in ft.OCEAN)
    + " FROM (SELECT *, date - 28 AS d4, date - 56 AS d8, date - 84 AS d12 FROM fx_state) p"
    + " ASOF LEFT JOIN fx_ocean o0 ON o0.date <= p.date"
    + "".join(f" ASOF LEFT JOIN fx_ocean o{k} ON o{k}.date <= p.d{k}" for k in (4, 8, 12)), ASOF_NAMES)
register("j6_spatial_lag", lambda s, d: ft.spatial_lag(_state(s, d), t.edges(s, d)),
    f"SELECT s.uf, s.date, s.casos, casos_spatial_lag FROM fx_state s LEFT JOIN {SPATIAL} n ON n.uf = s.uf AND n.date = s.date",
    "casos_spatial_lag")
register("w9_time_index", lambda s, d: ft.time_index(_state(s, d)),
    "SELECT uf, date, casos, CAST((date - min(date) OVER (PARTITION BY uf)) // 7 AS INTEGER) AS time_idx FROM fx_state")
register("w10_encoder_cutoff", lambda s, d: ft.encoder_rows(_state(s, d), 52),
    """SELECT uf, date, casos, time_idx FROM (SELECT *, max(time_idx) OVER (PARTITION BY uf) AS last
       FROM (SELECT *, CAST((date - min(date) OVER (PARTITION BY uf)) // 7 AS INTEGER) AS time_idx FROM fx_state)) WHERE time_idx <= last - 52""")

SELECTED = "temp_min temp_med temp_max precip_tot rel_humid_med population incidence_rate".split()
register("p8_select_features", lambda s, d: ft.select_features(panel(s, d)),
    f"SELECT uf, date, casos, {', '.join(SELECTED)} FROM fx_panel", [c for c in SELECTED if c != "population"])
register("p9_infer_features", lambda s, d: ft.select_features(ft.horizon_targets(cut_lineage(panel(s, d))), exclude=("incidence_rate",)),
    f"SELECT uf, date, casos, {', '.join(SELECTED[:-1])} FROM fx_panel", SELECTED[:-2])
register("p13_covariate_roles",
    lambda s, d: _roles(s, d),
    """SELECT uf, date, time_idx, epiweek, casos, temp_max, temp_med, temp_min, precip_tot FROM
       (SELECT *, CAST((date - min(date) OVER (PARTITION BY uf)) // 7 AS INTEGER) AS time_idx FROM fx_panel)""",
    "temp_max temp_med temp_min precip_tot")

FEATURES = f"""SELECT uf, date, epiweek, casos, {', '.join(PANEL_DOUBLES.split())}, {CLIMATE}, {TIME}, casos_spatial_lag,
    {', '.join(lags_sql() + rolling_sql() + diffs_sql() + HORIZONS)}
    FROM fx_panel LEFT JOIN {SPATIAL} USING (uf, date) {W}"""
FEATURE_DOUBLES = [*PANEL_DOUBLES.split(), *CLIMATE_DOUBLES.split(), *TIME_DOUBLES.split(), "casos_spatial_lag", *rolling_doubles(), *DIFF_DOUBLES]


def _plain(s, d):
    return panel(s, d).drop("population", "incidence_rate")


def _roles(s, d):
    df = ft.time_index(cut_lineage(_plain(s, d)))
    roles = ft.covariate_roles(df, most=5)
    return df.select("uf", "date", *roles["known"], *[c for c in roles["unknown"] if c not in roles["known"]])


register("c11_build_feature_set", lambda s, d: build_feature_set(_plain(s, d), edges=t.edges(s, d), drop_incomplete=False),
    FEATURES, FEATURE_DOUBLES)
register("c11_complete_rows_only", lambda s, d: build_feature_set(_plain(s, d), edges=t.edges(s, d)),
    f"SELECT * FROM (SELECT COLUMNS(*) FROM ({FEATURES})) AS f WHERE NOT (" + " OR ".join(
        f"{c} IS NULL" for c in [*PANEL_DOUBLES.split(), "casos_spatial_lag", *[x.split(' AS ')[-1] for x in lags_sql() + rolling_sql() + diffs_sql() + HORIZONS]]) + ")",
    FEATURE_DOUBLES)
NUMERIC = ["casos", *PANEL_DOUBLES.split(), "population", "incidence_rate"]
_FILLED = """SELECT * REPLACE (CAST(coalesce(last_value(population IGNORE NULLS) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(population IGNORE NULLS) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS BIGINT) AS population) FROM fx_panel"""
_CAPPED = "(" + capped_sql("incidence_rate", "(" + capped_sql("casos", f"({_FILLED})") + ")") + ")"
t.CTES["fx_ready"] = f"""SELECT *, ln(1 + incidence_rate) AS log_incidence, ln(1 + casos) AS log_cases
    FROM (SELECT * REPLACE (casos / nullif(population, 0) * 100000 AS incidence_rate)
    FROM ({seasonal_sql(NUMERIC, _CAPPED)}))"""
_READY_NAMES = [
    *NUMERIC[1:], "log_incidence", "log_cases", "week_of_year", "month", "day_of_year", "quarter", *TIME_DOUBLES.split(), "is_dengue_season",
    *CLIMATE_DOUBLES.split(), *[x.split(" AS ")[-1] for x in lags_sql() + rolling_sql() + diffs_sql()], "casos_spatial_lag",
]
_INTS = {"week_of_year", "month", "day_of_year", "quarter", "is_dengue_season"}
register("c12_prepare_states",
    lambda s, d: prepare_states(t.dengue(s, d), t.climate(s, d), t.population(s, d), edges=t.edges(s, d)),
    f"""SELECT uf, date, casos, {', '.join(_READY_NAMES)} FROM
        (SELECT *, {CLIMATE}, {TIME}, {', '.join(lags_sql() + rolling_sql() + diffs_sql())} FROM fx_ready {W})
        LEFT JOIN (SELECT e.uf, r.date, avg(r.casos) AS casos_spatial_lag FROM fx_edges e JOIN fx_ready r ON r.uf = e.neighbor GROUP BY e.uf, r.date) USING (uf, date)""",
    ["casos", *[c for c in _READY_NAMES if c not in _INTS]])
register("x4_transform_callback",
    lambda s, d: _state(s, d).transform(lambda df: ft.lag_features(df, lags=[1])).transform(lambda df: df.withColumn("up", F.col("casos") > F.col("casos_lag_1"))),
    f"SELECT uf, date, casos, lag(casos, 1) OVER w AS casos_lag_1, casos > lag(casos, 1) OVER w AS up FROM fx_state {W}")
