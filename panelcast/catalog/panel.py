"""Merging, rolling up and filtering."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.registry import register
from panelcast.operators import merge as m
from panelcast.operators.prep import dedup_keep_last
from panelcast.operators.seasons import assign_seasons, plot_window, train_rows
from panelcast.plans.backtest import train_test_counts

CLIMATE = "temp_min temp_med temp_max precip_tot rel_humid_med"
MERGED = f"date, geocode, uf, epiweek, casos, {CLIMATE.replace(' ', ', ')}"


def merged(spark, d, carry=False):
    return m.merge_sources(
        t.flagged(spark, d), t.climate(spark, d), t.population(spark, d), t.environ(spark, d), carry_population=carry
    )


def panel(spark, d):
    df = merged(spark, d).drop("year", *m.FLAGS)
    return m.aggregate_to_state(df)


register("s8_ocean_range", lambda s, d: m.ocean_range(t.ocean(s, d), "1996-01-01", "1999-12-31"),
    "SELECT * FROM fx_ocean WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' ORDER BY date", "enso iod pdo")
register("p1_filter_state_date", lambda s, d: m.filter_panel(t.dengue(s, d), ["NATION_3"], "1997-01-01", "1999-12-31"),
    "SELECT * FROM fx_dengue WHERE uf = 'NATION_3' AND date >= DATE '1997-01-01' AND date <= DATE '1999-12-31'")
register("p2_climate_projection", lambda s, d: m.climate_columns(t.climate(s, d)),
    "SELECT date, epiweek, geocode, temp_min, temp_med, temp_max, precip_tot, rel_humid_med FROM fx_climate", CLIMATE)
register("p3_filter_states", lambda s, d: m.filter_panel(t.state(s, d), ["NATION_3", "NATION_7", "NATION_12"]),
    "SELECT * FROM fx_state WHERE uf IN ('NATION_3', 'NATION_7', 'NATION_12')")
register("p4_train_cutoff", lambda s, d: train_rows(t.state(s, d), t.TRAIN_END),
    f"SELECT * FROM fx_state WHERE date <= DATE '{t.TRAIN_END}'")
register("p5_flag_split",
    lambda s, d: m.flag_split(t.flagged(s, d), "train").select("uf", "date", "geocode", "casos", F.lit("train").alias("role"))
        .unionByName(m.flag_split(t.flagged(s, d), "target").select("uf", "date", "geocode", "casos", F.lit("target").alias("role"))),
    """SELECT uf, date, geocode, casos, 'train' AS role FROM fx_flagged WHERE train_3
       UNION ALL SELECT uf, date, geocode, casos, 'target' FROM fx_flagged WHERE target_3""")
register("p10_plot_window", lambda s, d: plot_window(t.state(s, d), t.TRAIN_END, "2001-06-24"),
    f"""SELECT *, CASE WHEN date <= DATE '{t.TRAIN_END}' THEN 'training' ELSE 'prediction' END AS phase FROM fx_state
        WHERE date BETWEEN DATE '{t.TRAIN_END}' - 365 AND DATE '2001-06-24' + 30""")
register("p11_season_roles",
    lambda s, d: train_test_counts(t.state(s, d), t.SEASONS),
    """SELECT uf, test, count(*) FILTER (date <= train_end) AS n_train,
              count(*) FILTER (date BETWEEN target_start AND target_end) AS n_target
       FROM fx_state JOIN fx_seasons ON date <= train_end OR date BETWEEN target_start AND target_end GROUP BY uf, test""")
register("j1_join_climate", lambda s, d: m.join_climate(t.dengue(s, d), t.climate(s, d)),
    f"SELECT {MERGED} FROM fx_dengue LEFT JOIN fx_climate USING (date, geocode, epiweek)", CLIMATE)
register("j2_join_population", lambda s, d: m.join_population(t.dengue(s, d), t.population(s, d)),
    """SELECT f.*, CAST(year(date) AS INTEGER) AS year, p.population FROM fx_dengue f
       LEFT JOIN fx_population p ON p.geocode = f.geocode AND p.year = year(f.date)""")
register("j2_population_carried", lambda s, d: m.join_population(t.dengue(s, d), t.population(s, d, last_year=2000), carry_forward=True),
    """SELECT f.*, CAST(year(date) AS INTEGER) AS year,
              (SELECT max_by(p.population, p.year) FROM fx_population p WHERE p.geocode = f.geocode AND p.year <= least(year(f.date), 2000)) AS population
       FROM fx_dengue f""")
register("j3_join_environ", lambda s, d: m.join_environ(t.dengue(s, d), t.environ(s, d)),
    "SELECT f.*, koppen, biome FROM fx_dengue f LEFT JOIN fx_environ e ON e.geocode = f.geocode")
register("j4_load_merged", lambda s, d: merged(s, d).drop(*m.FLAGS),
    f"SELECT {MERGED}, year, population, koppen, biome FROM fx_merged", CLIMATE)
register("j9_season_range_join", lambda s, d: assign_seasons(t.state(s, d), t.SEASONS),
    """SELECT uf, date, epiweek, casos, test, season, CASE WHEN date <= train_end THEN 'train' ELSE 'target' END AS role
       FROM fx_state JOIN fx_seasons ON date <= train_end OR date BETWEEN target_start AND target_end""")
register("j10_state_from_geocode", lambda s, d: m.state_from_geocode(t.dengue(s, d), t.codes(s, d)),
    """SELECT f.*, n_name AS state FROM fx_dengue f
       LEFT JOIN nation ON n_nationkey + 10 = CAST(substr(CAST(geocode AS VARCHAR), 1, 2) AS INTEGER)""")
register("a1_aggregate_to_state", lambda s, d: m.aggregate_to_state(merged(s, d)),
    f"""SELECT uf, date, epiweek, casos, {CLIMATE.replace(' ', ', ')}, population, incidence_rate,
        train_1, train_2, train_3, target_1, target_2, target_3
        FROM fx_panel JOIN (SELECT uf, date, epiweek, bool_or(train_1) AS train_1, bool_or(train_2) AS train_2,
        bool_or(train_3) AS train_3, bool_or(target_1) AS target_1, bool_or(target_2) AS target_2, bool_or(target_3) AS target_3
        FROM fx_flagged GROUP BY uf, date, epiweek) USING (uf, date, epiweek)""", CLIMATE + " incidence_rate")
register("a2_load_all_states", lambda s, d: panel(s, d).orderBy("uf", "date"),
    "SELECT * FROM fx_panel ORDER BY uf, date", CLIMATE + " incidence_rate")
register("a2_load_state", lambda s, d: m.filter_panel(panel(s, d), ["NATION_9"], "1996-01-01", None).orderBy("date"),
    "SELECT * FROM fx_panel WHERE uf = 'NATION_9' AND date >= DATE '1996-01-01' ORDER BY date", CLIMATE + " incidence_rate")
register("a3_available_states", lambda s, d: m.available_states(t.dengue(s, d)),
    "SELECT DISTINCT uf FROM fx_dengue ORDER BY uf")
register("a4_date_range", lambda s, d: m.date_range(t.dengue(s, d)),
    "SELECT strftime(min(date), '%Y-%m-%d') AS min_date, strftime(max(date), '%Y-%m-%d') AS max_date FROM fx_dengue")
register("a5_dedup_keep_last",
    lambda s, d: dedup_keep_last(t.dengue(s, d).select("uf", "date", "geocode", "casos"), "geocode"),
    """SELECT uf, date, geocode, casos FROM (SELECT *, row_number() OVER (PARTITION BY uf, date ORDER BY geocode DESC, casos DESC) AS rn
       FROM fx_dengue) WHERE rn = 1""")
register("a16_data_profile", lambda s, d: m.profile(panel(s, d)),
    " UNION ALL ".join(
        f"""SELECT count(*) AS n_rows, min(date) AS min_date, max(date) AS max_date, '{c}' AS "column",
            avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS missing_pct FROM fx_panel"""
        for c in ("uf", "epiweek", "casos", *CLIMATE.split(), "population", "incidence_rate")), "missing_pct")
register("o1_sorted_by_date", lambda s, d: t.state(s, d).orderBy("uf", "date"), "SELECT * FROM fx_state ORDER BY uf, date")
