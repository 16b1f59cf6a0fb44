"""Cleaning, imputation, normalization and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.catalog import tables as t
from panelcast.catalog.panel import panel
from panelcast.catalog.registry import register
from panelcast.functions.scalar import finite, next_sunday, ratio
from panelcast.operators import prep as p

from panelcast.plans.prepare import prepare_for_modeling
from panelcast.session import cut_lineage

PANEL = "temp_min temp_med temp_max precip_tot rel_humid_med incidence_rate"


def sparse(spark, d):
    """Weekly cases and climate per state; climate is missing where no supplier shipped.

    Written once: the operators below read it several times.
    """
    df = panel(spark, d).select("uf", "date", "epiweek", "casos", "temp_med", "population", "incidence_rate")
    return cut_lineage(df)


SPARSE = "(SELECT uf, date, epiweek, casos, temp_med, population, incidence_rate FROM fx_panel)"


def bounds_sql(c: str, source: str = "fx_panel", names: str = "lower upper") -> str:
    lower, upper = names.split()
    return (
        f"SELECT uf, quantile_cont({c}, 0.25) - 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {lower}, "
        f"quantile_cont({c}, 0.75) + 3 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {upper} FROM {source} GROUP BY uf"
    )


register("a6_iqr_bounds", lambda s, d: p.outlier_bounds(sparse(s, d), ["incidence_rate"]),
    bounds_sql("incidence_rate", names="lower_incidence_rate upper_incidence_rate"), "lower_incidence_rate upper_incidence_rate")
register("a6_iqr_bounds_raw_rows",
    lambda s, d: p.outlier_bounds(t.table(s, d, "lineitem").withColumn("price", F.col("l_extendedprice")), ["price"], keys=["l_returnflag"]),
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) - 3 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS lower_price,
       quantile_cont(l_extendedprice, 0.75) + 3 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) AS upper_price
       FROM lineitem GROUP BY l_returnflag""", "lower_price upper_price")
register("a7_zscore_bounds", lambda s, d: p.outlier_bounds(sparse(s, d), ["casos"], "zscore"),
    "SELECT uf, avg(casos) - 3 * stddev_samp(casos) AS lower_casos, avg(casos) + 3 * stddev_samp(casos) AS upper_casos FROM fx_panel GROUP BY uf",
    "lower_casos upper_casos")
register("a8_week_medians",
    lambda s, d: t.state(s, d).groupBy("uf", (F.col("epiweek") % 100).alias("week")).agg(F.median("casos").alias("median_cases")),
    "SELECT uf, epiweek % 100 AS week, median(casos) AS median_cases FROM fx_state GROUP BY 1, 2", "median_cases")
register("w7_forward_fill",
    lambda s, d: p.carry_columns(sparse(s, d), ["temp_med", "population"]),
    f"""SELECT uf, date, epiweek, casos, incidence_rate,
        coalesce(last_value(temp_med IGNORE NULLS) OVER b, first_value(temp_med IGNORE NULLS) OVER a) AS temp_med,
        coalesce(last_value(population IGNORE NULLS) OVER b, first_value(population IGNORE NULLS) OVER a) AS population
        FROM {SPARSE} WINDOW b AS (PARTITION BY uf ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY uf ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "temp_med incidence_rate")
LINE = f"""SELECT uf, date, epiweek, casos, population, incidence_rate, pos,
    CASE WHEN temp_med IS NOT NULL THEN temp_med WHEN nx IS NULL THEN pv
         ELSE pv + (nx - pv) * (pos - pp) / (np - pp) END AS temp_med,
    CASE WHEN temp_med IS NULL THEN coalesce(np, n + 1) - pp - 1 END AS gap
    FROM (SELECT *, last_value(temp_med IGNORE NULLS) OVER b AS pv, first_value(temp_med IGNORE NULLS) OVER a AS nx,
          last_value(CASE WHEN temp_med IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
          first_value(CASE WHEN temp_med IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np
          FROM (SELECT *, row_number() OVER (PARTITION BY uf ORDER BY date) AS pos, count(*) OVER (PARTITION BY uf) AS n FROM {SPARSE})
          WINDOW b AS (PARTITION BY uf ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          a AS (PARTITION BY uf ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
COLS = "uf, date, epiweek, casos, population, incidence_rate, temp_med"
register("w8_linear_interpolation", lambda s, d: p.interpolate_columns(sparse(s, d), ["temp_med"]),
    f"SELECT {COLS} FROM ({LINE})", "temp_med incidence_rate")
register("w8_linear_max_gap", lambda s, d: p.interpolate_columns(sparse(s, d), ["temp_med"], max_gap=2),
    f"SELECT {COLS.replace('temp_med', 'CASE WHEN gap IS NULL OR gap <= 2 THEN temp_med END AS temp_med')} FROM ({LINE})",
    "temp_med incidence_rate")


def capped_sql(c: str, source: str) -> str:
    return (
        f"SELECT s.* REPLACE (CASE WHEN {c} < lower THEN lower WHEN {c} > upper THEN upper ELSE CAST({c} AS DOUBLE) END AS {c}) "
        f"FROM {source} s LEFT JOIN ({bounds_sql(c, source)}) o ON o.uf = s.uf"
    )


register("c2_outliers_cap", lambda s, d: p.handle_outliers(sparse(s, d), ["incidence_rate"], "cap"),
    capped_sql("incidence_rate", SPARSE), "incidence_rate temp_med")
register("c2_outliers_remove", lambda s, d: p.handle_outliers(sparse(s, d), ["incidence_rate"], "remove"),
    f"""SELECT s.* FROM {SPARSE} s LEFT JOIN ({bounds_sql('incidence_rate')}) o ON o.uf = s.uf
        WHERE incidence_rate IS NULL OR incidence_rate BETWEEN lower AND upper""", "incidence_rate temp_med")
register("c2_outliers_null_zscore", lambda s, d: p.handle_outliers(sparse(s, d), ["casos"], "nan", "zscore", 2.0),
    f"""SELECT s.* REPLACE (CASE WHEN casos BETWEEN lo AND hi THEN casos END AS casos) FROM {SPARSE} s
        LEFT JOIN (SELECT uf, avg(casos) - 2 * stddev_samp(casos) AS lo, avg(casos) + 2 * stddev_samp(casos) AS hi
        FROM fx_panel GROUP BY uf) o ON o.uf = s.uf""", "incidence_rate temp_med")
FILLED = f"""SELECT * REPLACE (CAST(coalesce(last_value(population IGNORE NULLS) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(population IGNORE NULLS) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS BIGINT) AS population)
    FROM {SPARSE}"""
CLEAN = capped_sql("incidence_rate", f"({capped_sql('casos', f'({FILLED})')})")
register("c1_clean", lambda s, d: p.clean(sparse(s, d), order="epiweek"), CLEAN, "casos temp_med incidence_rate")
register("f10_repair_types",
    lambda s, d: p.repair_types(t.table(s, d, "orders").select(
        F.col("o_orderdate").cast("string").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("epiweek"),
        (F.col("o_custkey") - 500).alias("casos"))),
    """SELECT CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderkey AS INTEGER) END AS epiweek,
       greatest(o_custkey - 500, 0) AS casos FROM orders""")


def seasonal_sql(columns: list[str], source: str, by: str = "epiweek % 100") -> str:
    sets = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), median({c}) OVER (PARTITION BY uf, {by}), median({c}) OVER (PARTITION BY uf)) AS {c}"
        for c in columns
    )
    return f"SELECT * REPLACE ({sets}) FROM {source}"


register("c3_impute_seasonal", lambda s, d: p.impute_seasonal(sparse(s, d), ["temp_med", "incidence_rate"]),
    seasonal_sql(["temp_med", "incidence_rate"], SPARSE), "temp_med incidence_rate")
register("c3_impute_by_epiweek", lambda s, d: p.impute_seasonal(sparse(s, d), ["temp_med"], by="epiweek"),
    seasonal_sql(["temp_med"], SPARSE, "epiweek"), "temp_med incidence_rate")
register("c4_impute_linear", lambda s, d: p.impute(sparse(s, d), "linear", ["temp_med"]),
    f"SELECT {COLS.replace('temp_med', 'coalesce(temp_med, g) AS temp_med')} FROM (SELECT *, median(temp_med) OVER (PARTITION BY uf) AS g FROM ({LINE}))",
    "temp_med incidence_rate")
# the tridiagonal system of all known weeks of a state: elimination forwards, bends backwards
SPLINE = f"""(WITH RECURSIVE rows_at AS (SELECT *, row_number() OVER (PARTITION BY uf ORDER BY date) AS pos FROM {SPARSE}),
    k AS (SELECT uf, pos, temp_med AS y, row_number() OVER w AS i, count(*) OVER (PARTITION BY uf) AS n, lead(pos) OVER w AS pos1, lead(temp_med) OVER w AS y1,
              pos - lag(pos) OVER w AS h0, lead(pos) OVER w - pos AS h1, (temp_med - lag(temp_med) OVER w) / (pos - lag(pos) OVER w) AS d0,
              (lead(temp_med) OVER w - temp_med) / (lead(pos) OVER w - pos) AS d1
          FROM rows_at WHERE temp_med IS NOT NULL WINDOW w AS (PARTITION BY uf ORDER BY pos)),
    f AS (SELECT uf, i, CAST(0 AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS d FROM k WHERE i = 1
          UNION ALL SELECT k.uf, k.i, k.h1 / (2 * (k.h0 + k.h1) - k.h0 * f.c), (6 * (k.d1 - k.d0) - k.h0 * f.d) / (2 * (k.h0 + k.h1) - k.h0 * f.c)
          FROM f JOIN k ON k.uf = f.uf AND k.i = f.i + 1 WHERE k.i < k.n),
    b AS (SELECT uf, i, CAST(0 AS DOUBLE) AS m FROM k WHERE i = n
          UNION ALL SELECT f.uf, f.i, f.d - f.c * b.m FROM b JOIN f ON f.uf = b.uf AND f.i = b.i - 1),
    g AS (SELECT k.uf, k.pos, k.pos1, k.y, k.y1, k.h1, b.m AS m0, e.m AS m1 FROM k JOIN b ON b.uf = k.uf AND b.i = k.i JOIN b AS e ON e.uf = k.uf AND e.i = k.i + 1 WHERE k.h1 > 1)
    SELECT r.* EXCLUDE (pos, temp_med), coalesce(r.temp_med, (g.m0 * (g.pos1 - r.pos) ** 3 + g.m1 * (r.pos - g.pos) ** 3) / (6 * g.h1)
        + (g.y / g.h1 - g.m0 * g.h1 / 6) * (g.pos1 - r.pos) + (g.y1 / g.h1 - g.m1 * g.h1 / 6) * (r.pos - g.pos)) AS temp_med
    FROM rows_at r LEFT JOIN g ON g.uf = r.uf AND g.pos < r.pos AND r.pos < g.pos1)"""
register("c5_impute_spline", lambda s, d: p.impute(sparse(s, d), "spline", ["temp_med"]),
    f"SELECT {COLS.replace('temp_med', 'coalesce(temp_med, g) AS temp_med')} FROM (SELECT *, median(temp_med) OVER (PARTITION BY uf) AS g FROM {SPLINE})",
    "temp_med incidence_rate")
register("c6_impute_forward", lambda s, d: p.impute(sparse(s, d), "forward", ["temp_med"]),
    f"""SELECT * REPLACE (coalesce(last_value(temp_med IGNORE NULLS) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(temp_med IGNORE NULLS) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temp_med) FROM {SPARSE}""",
    "temp_med incidence_rate")
register("f7_incidence_rate",
    lambda s, d: panel(s, d).select("uf", "date", (ratio(F.col("casos"), F.col("population")) * 100000).alias("rate")),
    "SELECT uf, date, casos / nullif(population, 0) * 100000 AS rate FROM fx_panel", "rate")
register("f8_logs", lambda s, d: panel(s, d).select("uf", "date", F.log1p("incidence_rate").alias("li"), F.log1p(F.col("casos").cast("double")).alias("lc")),
    "SELECT uf, date, ln(1 + incidence_rate) AS li, ln(1 + casos) AS lc FROM fx_panel", "li lc")
register("f9_week_of_epiweek", lambda s, d: t.state(s, d).select("uf", "date", p.week_of_epiweek(F.col("epiweek")).alias("week")),
    "SELECT uf, date, epiweek % 100 AS week FROM fx_state")
register("c7_epi_features", lambda s, d: p.epi_features(sparse(s, d)),
    f"""SELECT * REPLACE (casos / nullif(population, 0) * 100000 AS incidence_rate), ln(1 + casos / nullif(population, 0) * 100000) AS log_incidence,
        ln(1 + casos) AS log_cases, epiweek % 100 AS week_of_year FROM {SPARSE}""",
    "temp_med incidence_rate log_incidence log_cases")
register("p12_nonfinite_cleanup",
    lambda s, d: panel(s, d).select("uf", "date",
        finite(F.when(F.col("casos") == 1, F.lit(float("inf"))).when(F.col("casos") == 2, F.lit(float("nan"))).otherwise(F.col("temp_med"))).alias("x"),
        F.coalesce(finite(F.when(F.col("casos") == 2, F.lit(float("nan"))).otherwise(F.col("incidence_rate"))), F.lit(0.0)).alias("y")),
    """SELECT uf, date, CASE WHEN casos NOT IN (1, 2) THEN temp_med END AS x,
       CASE WHEN casos = 2 THEN 0 ELSE coalesce(incidence_rate, 0) END AS y FROM fx_panel""", "x y")

NORM = {
    "standard": "({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-8)",
    "minmax": "({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-8)",
    "robust": "({c} - median({c}) OVER w) / (quantile_cont({c}, 0.75) OVER w - quantile_cont({c}, 0.25) OVER w + 1e-8)",
}
for _method, _expr in NORM.items():
    register(f"c8_normalize_{_method}",
        lambda s, d, k=_method: p.normalize(sparse(s, d), ["incidence_rate", "temp_med"], k),
        f"""SELECT * REPLACE ({_expr.format(c='incidence_rate')} AS incidence_rate, {_expr.format(c='temp_med')} AS temp_med)
            FROM {SPARSE} WINDOW w AS (PARTITION BY uf)""", "incidence_rate temp_med")


def _by_day(s, d):
    """Orders per customer and day: series whose dates keep to no weekly calendar."""
    date = F.col("o_orderdate").cast("date")
    rows = t.table(s, d, "orders").groupBy("o_custkey", date.alias("date")).agg(F.count(F.lit(1)).alias("casos"))
    return rows.select("o_custkey", "date", (F.year("date") * 100 + F.weekofyear("date")).cast("int").alias("epiweek"), "casos")


register("c9_fill_date_gaps", lambda s, d: p.fill_date_gaps(t.stored_state(s, d).select("uf", "date", "casos")),
    """SELECT k.uf, k.date, casos FROM (SELECT uf, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date
       FROM fx_state GROUP BY uf) k LEFT JOIN fx_state s ON s.uf = k.uf AND s.date = k.date""")
register("c9_fill_gaps_by_place",
    lambda s, d: p.fill_date_gaps(cut_lineage(t.dengue(s, d).select("geocode", "uf", "date", "casos")), p.Series(key=("geocode",)), constants=["uf"]),
    """SELECT k.geocode, k.date, k.uf, casos FROM (SELECT geocode, min(uf) AS uf, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date
       FROM fx_dengue GROUP BY geocode) k LEFT JOIN fx_dengue s ON s.geocode = k.geocode AND s.date = k.date""")
register("c9_fill_gaps_off_the_calendar",
    lambda s, d: p.fill_date_gaps(cut_lineage(_by_day(s, d)), p.Series(key=("o_custkey",))),
    """WITH k AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) * 100 + weekofyear(o_orderdate) AS INTEGER) AS epiweek, count(*) AS casos FROM orders GROUP BY ALL),
       e AS (SELECT o_custkey, min(date) AS a, max(date) AS b FROM k GROUP BY 1),
       c AS (SELECT o_custkey, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS date FROM e)
       SELECT * FROM k UNION ALL
       SELECT o_custkey, date, CAST(year(date) * 100 + weekofyear(date) AS INTEGER), NULL FROM c
       WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.o_custkey = c.o_custkey AND k.date >= c.date AND k.date < c.date + 7)""")
register("p6_drop_incomplete", lambda s, d: sparse(s, d).dropna(subset=["casos"]).dropna("any"),
    f"SELECT * FROM {SPARSE} WHERE temp_med IS NOT NULL AND population IS NOT NULL AND incidence_rate IS NOT NULL",
    "temp_med incidence_rate")
PREPARED = f"""SELECT *, CAST(ln(1 + incidence_rate) AS DOUBLE) AS log_incidence, ln(1 + casos) AS log_cases, epiweek % 100 AS week_of_year
    FROM (SELECT * REPLACE (casos / nullif(population, 0) * 100000 AS incidence_rate)
    FROM ({seasonal_sql(['casos', 'temp_med', 'population', 'incidence_rate'], f'({CLEAN})')}))"""
register("c10_prepare_for_modeling", lambda s, d: prepare_for_modeling(sparse(s, d), order="epiweek"), PREPARED,
    "casos temp_med population incidence_rate log_incidence log_cases")
register("f11_future_dates", lambda s, d: p.future_dates(t.state(s, d), 12),
    """SELECT uf, CAST(step AS INTEGER) AS step, CAST(last_date + CAST(step * 7 AS INTEGER) AS DATE) AS date
       FROM (SELECT uf, max(date) AS last_date FROM fx_state GROUP BY uf), range(1, 13) AS r(step)""")
register("f11_roll_to_sunday",
    lambda s, d: t.table(s, d, "orders").select("o_orderkey", next_sunday(F.col("o_orderdate").cast("date")).alias("sunday")),
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER) AS DATE) AS sunday FROM orders""")

