"""Panel tables made from the retail star schema, in Spark and as SQL for checking.

Orders stand in for weekly cases (nation = state, customer group = municipality),
line items for weekly climate, monthly order totals for ocean indices. Fact rows meet
their dimensions in salted joins (or broadcast ones, where Spark measures the dimension
small), so a key with a third of all rows never sits in one task, and are then summed
map-side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.scalar import week_start
from panelcast.operators.forecasts import baseline_forecasts
from panelcast.operators.groups import attach
from panelcast.operators.scores import ALL_LEVELS, CRPS_COLUMNS, LEVELS, QUANTILE_COLUMNS, evaluate
from panelcast.plans.backtest import score_seasons, season_forecasts
from panelcast.session import cut_lineage

# Backtest windows inside the dates the tables cover.
SEASONS = [
    ("1", "1998-1999", "1998-06-28", "1998-10-04", "1999-09-26"),
    ("2", "1999-2000", "1999-06-27", "1999-10-03", "2000-09-24"),
    ("3", "2000-2001", "2000-06-25", "2000-10-01", "2001-09-23"),
]
# the run after the tests: what it forecasts has not been observed
FINAL = ("final", "2001-2002", "2001-06-24", "2001-10-07", "2002-09-29")
TRAIN_END = "2000-06-25"


# Stated schemas spare every query a job per table to find them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _epiweek(c: str = "date"):
    return (F.year(c) * 100 + F.weekofyear(c)).cast("int").alias("epiweek")


def _dimension(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Inner join of a fact table to a dimension, safe for a key with a third of all rows.

    Few salts: dimensions are larger than group statistics, and the skew handling of
    adaptive execution splits further what is still too large.
    """
    known = dim.withColumnRenamed(dim_key, fact_key).withColumn("_known", F.lit(True))
    return attach(fact, known, [fact_key], ["date"], salts=4).where("_known").drop("_known")


def dengue(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", week_start(F.col("o_orderdate")).alias("date"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("uf"))
    placed = _dimension(_dimension(orders, customers, "o_custkey", "c_custkey"), nations, "c_nationkey", "n_nationkey")
    geocode = ((F.col("c_nationkey") + 10) * 100000 + F.col("o_custkey") % 10).cast("int")
    grouped = placed.groupBy("date", geocode.alias("geocode"), "uf").agg(F.count(F.lit(1)).alias("casos"))
    return grouped.select("date", "geocode", "uf", _epiweek(), "casos")


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with the train and target flags of the backtests."""
    flags = {}
    for test, _, train_end, start, end in SEASONS:
        flags[f"train_{test}"] = F.col("date") <= F.lit(train_end).cast("date")
        flags[f"target_{test}"] = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return dengue(spark, folder).withColumns(flags)


def climate(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select(
        "l_suppkey", week_start(F.col("l_shipdate")).alias("date"), "l_discount", "l_tax", "l_quantity"
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    geocode = ((F.col("s_nationkey") + 10) * 100000 + F.col("l_suppkey") % 10).cast("int")
    return (
        _dimension(items, suppliers, "l_suppkey", "s_suppkey")
        .groupBy("date", geocode.alias("geocode"))
        .agg(
            (15 + F.min("l_discount") * 100).alias("temp_min"),
            (15 + F.avg("l_discount") * 100).alias("temp_med"),
            (15 + F.max("l_discount") * 100).alias("temp_max"),
            (F.sum("l_tax") * 10).alias("precip_tot"),
            (30 + F.avg("l_quantity")).alias("rel_humid_med"),
        )
        .withColumn("epiweek", _epiweek())
    )


def population(spark: SparkSession, folder: str, last_year: int | None = None) -> DataFrame:
    """Customers per place and year, up to ``last_year`` if it is given."""
    geocode = ((F.col("c_nationkey") + 10) * 100000 + F.col("c_custkey") % 10).cast("int")
    places = table(spark, folder, "customer").groupBy(geocode.alias("geocode")).agg(F.count(F.lit(1)).alias("n"))
    ends = table(spark, folder, "orders").agg(
        F.year(F.min("o_orderdate")).alias("y0"), F.least(F.year(F.max("o_orderdate")), F.lit(last_year)).alias("y1")
    )
    return attach(places, ends, [], ["geocode"]).select(
        "geocode", F.explode(F.sequence("y0", "y1")).alias("year"), (F.col("n") * 1000).alias("population")
    )


def environ(spark: SparkSession, folder: str) -> DataFrame:
    geocode = ((F.col("c_nationkey") + 10) * 100000 + F.col("c_custkey") % 10).cast("int")
    return (
        table(spark, folder, "customer")
        .groupBy(geocode.alias("geocode"))
        .agg(F.min("c_mktsegment").alias("koppen"), F.max("c_mktsegment").alias("biome"))
    )


def ocean(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return (
        orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
        .agg(
            F.min(week_start(F.col("o_orderdate"))).alias("date"),
            (F.avg("o_totalprice") / 100000).alias("enso"),
            (F.count(F.lit(1)).cast("double") / 100).alias("iod"),
            (F.max("o_totalprice") / 100000).alias("pdo"),
        )
        .drop("y", "m")
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of one region are neighbours."""
    nations = table(spark, folder, "nation")
    a = nations.select(F.col("n_name").alias("uf"), F.col("n_regionkey").alias("r"))
    b = nations.select(F.col("n_name").alias("neighbor"), F.col("n_regionkey").alias("r"))
    return a.join(b, "r").where(F.col("uf") != F.col("neighbor")).select("uf", "neighbor")


def codes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.col("n_name").alias("uf"), (F.col("n_nationkey") + 10).alias("code"))


def state(spark: SparkSession, folder: str) -> DataFrame:
    return dengue(spark, folder).groupBy("uf", "date", "epiweek").agg(F.sum("casos").alias("casos"))


# tables of a session by folder, state of its files and name, for all queries that read them
_STORED: dict[tuple, DataFrame] = {}
BEHIND_PANEL = ("orders", "customer", "nation")


def file_state(spark: SparkSession, folder: str) -> tuple:
    """Number and digest of the files behind the panel, by path, size and time of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder}/{n}.parquet" for n in BEHIND_PANEL])
    digest = F.sum(F.xxhash64("path", "length", "modificationTime") % (1 << 40))
    return tuple(files.agg(F.count("*"), digest).first())


def stored(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """``build()``, written once as long as the files behind the panel stay as they are."""
    at = (spark.sparkContext.applicationId, folder, file_state(spark, folder), name)
    if at not in _STORED:
        _STORED[at] = cut_lineage(build())
    return _STORED[at]


def stored_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state panel, written once: series operators read their input twice, and the
    roll-up behind it reads the fact table."""
    return stored(spark, folder, "state", lambda: state(spark, folder))


def forecast(spark: SparkSession, folder: str) -> DataFrame:
    return baseline_forecasts(stored_state(spark, folder))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate(forecast(spark, folder), ["uf", "model"], levels=ALL_LEVELS)


def tests(spark: SparkSession, folder: str) -> DataFrame:
    panel = stored_state(spark, folder)
    return score_seasons(season_forecasts(panel, SEASONS), panel)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Test scores with the parameters of each run; the first naive runs have none."""
    none = (F.col("model") == "naive") & (F.col("test") == "1")
    params = F.when(none, "").otherwise(F.concat("model", F.lit("/"), "test"))
    return tests(spark, folder).withColumn("params", params)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per nation: size, region, commonest market segment, demand pattern."""
    segments = table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    shape = segments.groupBy("c_nationkey").agg(
        F.sum("n").cast("double").alias("population"),
        F.min_by("c_mktsegment", F.struct(-F.col("n"), F.col("c_mktsegment"))).alias("biome"),
    )
    demand = state(spark, folder).groupBy("uf").agg(F.avg("casos").alias("avg_cases"), F.max("casos").alias("peak"))
    regions = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("climate_zone"))
    return (
        table(spark, folder, "nation")
        .join(shape, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(demand, F.col("n_name") == F.col("uf"))
        .select(
            F.col("n_name").alias("state_uf"), "population", "climate_zone", "biome", "avg_cases",
            F.when(F.col("peak") >= 3.5 * F.col("avg_cases"), "epidemic").otherwise("endemic").alias("historical_pattern"),
        )
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Order values of a state and week as the samples of a forecast row."""
    nations = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("uf"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", week_start(F.col("o_orderdate")).alias("date")
    )
    placed = _dimension(_dimension(orders, customers, "o_custkey", "c_custkey"), nations, "c_nationkey", "n_nationkey")
    return placed.select("uf", "date", F.col("o_orderkey").alias("sample_id"), F.col("o_totalprice").alias("value"))


# ---- the same tables as SQL ------------------------------------------------------------

SUNDAY = "CAST(CAST({0} AS DATE) - CAST(dayofweek({0}) AS INTEGER) AS DATE)"
_GEO_C = "CAST((10 + c_nationkey) * 100000 + c_custkey % 10 AS INTEGER)"
_GEO_S = "CAST((10 + s_nationkey) * 100000 + s_suppkey % 10 AS INTEGER)"
_EPIWEEK = "CAST(year(date) * 100 + weekofyear(date) AS INTEGER)"


def pinball_sql(y: str, q: float, v: str) -> str:
    return f"(CASE WHEN {y} >= {v} THEN ({y} - {v}) * {q} ELSE ({v} - {y}) * (1 - {q}) END)"


def crps_sql(y: str = "casos", names: list[str] = CRPS_COLUMNS) -> str:
    """The quantile score written out from its definition."""
    pairs = sorted((QUANTILE_COLUMNS[c], c) for c in names)
    seg = []
    for (p, u), (q, v) in zip(pairs, pairs[1:]):
        seg.append(
            f"({v} - {u}) * (CASE WHEN {y} >= {u} THEN ({y} - {u}) * {p} * {p} ELSE 0 END"
            f" + CASE WHEN {y} < {v} THEN ({y} - {v}) * (1 - {q}) * (1 - {q}) ELSE 0 END"
            f" + CASE WHEN {y} < {u} THEN ({y} - {u}) * ({p} - 1) * ({p} - 1) ELSE 0 END"
            f" + CASE WHEN {y} >= {v} THEN ({y} - {v}) * {q} * {q} ELSE 0 END)"
        )
    pin = [f"2 * {pinball_sql(y, q, v)}" for q, v in pairs]
    return f"(({' + '.join(seg)} + {' + '.join(pin)}) / {len(pairs)})"


def wis_sql(level: int, y: str = "casos") -> str:
    a = f"(1 - {level} / 100.0::DOUBLE)"
    low, high = f"lower_{level}", f"upper_{level}"
    return (
        f"({a} / 2 * ({high} - {low}) + 2 / {a} * (greatest(0, {low} - {y}) + greatest(0, {y} - {high}))"
        f" + abs({y} - median))"
    )


def score_columns(levels: list[int], y: str = "casos") -> dict[str, str]:
    pin = " + ".join(pinball_sql(y, QUANTILE_COLUMNS[c], c) for c in CRPS_COLUMNS)
    out = {
        "rmse": f"sqrt(avg(({y} - median) * ({y} - median)))",
        "mae": f"avg(abs({y} - median))",
        "mape": f"100 * avg(abs(({y} - median) / (abs({y}) + 1e-8)))",
        "bias": f"avg(median - {y})",
    }
    for n in levels:
        out[f"coverage_{n}"] = f"avg(CASE WHEN {y} >= lower_{n} AND {y} <= upper_{n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        out[f"wis_{n}"] = f"avg({wis_sql(n, y)})"
        out[f"width_{n}"] = f"avg(upper_{n} - lower_{n})"
    out["crps"] = f"avg({crps_sql(y)})"
    out["crps_pinball"] = f"avg(({pin}) * 2 / {len(CRPS_COLUMNS)})"
    out["wis_total"] = f"avg(({' + '.join(wis_sql(n, y) for n in levels)}) / {len(levels)})"
    return out


def score_sql(levels: list[int], y: str = "casos") -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in score_columns(levels, y).items())


SCORE_NAMES = list(score_columns(ALL_LEVELS))
SCORE_NAMES_3 = list(score_columns(LEVELS))

_BOUNDS = ", ".join(
    f"greatest(median - {z} * sd, 0) AS lower_{n}, median + {z} * sd AS upper_{n}"
    for n, z in ((50, 0.67449), (80, 1.28155), (90, 1.64485), (95, 1.95996))
)
_SEASON_ROWS = ", ".join(
    f"('{t}', '{s}', DATE '{te}', DATE '{a}', DATE '{b}')" for t, s, te, a, b in SEASONS
)

_FINAL_ROW = "'{}', '{}', DATE '{}', DATE '{}', DATE '{}'".format(*FINAL)
BOUND_NAMES = ", ".join(f"{side}_{n}" for n in ALL_LEVELS for side in ("lower", "upper"))

CTES = {
    "fx_dengue": f"""
        SELECT date, geocode, uf, {_EPIWEEK} AS epiweek, count(*) AS casos
        FROM (SELECT {SUNDAY.format('o_orderdate')} AS date, {_GEO_C} AS geocode, n_name AS uf
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
        GROUP BY date, geocode, uf""",
    "fx_flagged": "SELECT *, " + ", ".join(
        f"date <= DATE '{te}' AS train_{t}, date BETWEEN DATE '{a}' AND DATE '{b}' AS target_{t}"
        for t, _, te, a, b in SEASONS
    ) + " FROM fx_dengue",
    "fx_climate": f"""
        SELECT date, geocode, {_EPIWEEK} AS epiweek,
               15 + min(l_discount) * 100 AS temp_min, 15 + avg(l_discount) * 100 AS temp_med,
               15 + max(l_discount) * 100 AS temp_max, sum(l_tax) * 10 AS precip_tot,
               30 + avg(l_quantity) AS rel_humid_med
        FROM (SELECT {SUNDAY.format('l_shipdate')} AS date, {_GEO_S} AS geocode, l_discount, l_tax, l_quantity
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
        GROUP BY date, geocode""",
    "fx_population": f"""
        SELECT geocode, CAST(y AS INTEGER) AS year, n * 1000 AS population
        FROM (SELECT {_GEO_C} AS geocode, count(*) AS n FROM customer GROUP BY 1)
        CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS y FROM orders)""",
    "fx_environ": f"""
        SELECT {_GEO_C} AS geocode, min(c_mktsegment) AS koppen, max(c_mktsegment) AS biome FROM customer GROUP BY 1""",
    "fx_ocean": f"""
        SELECT min({SUNDAY.format('o_orderdate')}) AS date, avg(o_totalprice) / 100000 AS enso,
               CAST(count(*) AS DOUBLE) / 100 AS iod, max(o_totalprice) / 100000 AS pdo
        FROM orders GROUP BY year(o_orderdate), month(o_orderdate)""",
    "fx_edges": """
        SELECT a.n_name AS uf, b.n_name AS neighbor FROM nation a JOIN nation b
        ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""",
    "fx_state": """
        SELECT uf, date, epiweek, CAST(sum(casos) AS BIGINT) AS casos FROM fx_dengue GROUP BY uf, date, epiweek""",
    "fx_base": """
        SELECT uf, date, casos, lag(casos, 1) OVER w AS m1, lag(casos, 52) OVER w AS m2,
               avg(casos) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS m3,
               stddev_samp(casos) OVER (PARTITION BY uf ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS sd
        FROM fx_state WINDOW w AS (PARTITION BY uf ORDER BY date)""",
    "fx_forecast": f"""
        SELECT uf, date, model, casos, median, {_BOUNDS}, sd
        FROM (SELECT uf, date, 'naive' AS model, casos, CAST(m1 AS DOUBLE) AS median, sd FROM fx_base
              UNION ALL SELECT uf, date, 'seasonal', casos, CAST(m2 AS DOUBLE), sd FROM fx_base
              UNION ALL SELECT uf, date, 'mean12', casos, m3, sd FROM fx_base)
        WHERE median IS NOT NULL AND sd IS NOT NULL""",
    "fx_metrics": f"SELECT uf, model, {score_sql(ALL_LEVELS)} FROM fx_forecast GROUP BY uf, model",
    "fx_seasons": f"SELECT * FROM (VALUES {_SEASON_ROWS}) AS v(test, season, train_end, target_start, target_end)",
    "fx_origin": f"""
        SELECT uf, test, train_end, target_start, target_end, max_by(casos, date)::DOUBLE AS latest, avg(casos) FILTER (rn <= 12) AS mean12,
               stddev_samp(casos) FILTER (rn <= 12) AS sd
        FROM (SELECT f.uf, f.date, f.casos, z.*, row_number() OVER (PARTITION BY f.uf, z.test ORDER BY f.date DESC) AS rn
              FROM fx_state f JOIN (SELECT * FROM fx_seasons UNION ALL SELECT {_FINAL_ROW}) z ON f.date <= z.train_end)
        GROUP BY uf, test, train_end, target_start, target_end""",
    "fx_weeks": """
        SELECT *, date - train_end AS ahead, CAST(date - CAST(364 * ceil((date - train_end) / 364.0::DOUBLE) AS INTEGER) AS DATE) AS like_date
        FROM (SELECT *, CAST(unnest(generate_series(target_start, target_end, INTERVAL 7 DAY)) AS DATE) AS date FROM fx_origin)""",
    "fx_ahead": f"""
        SELECT uf, test, model, date, median, {_BOUNDS} FROM (
            SELECT w.uf, w.test, m.model, w.date, w.sd * sqrt(1 + w.ahead / 364.0::DOUBLE) AS sd,
                   CASE m.model WHEN 'naive' THEN w.latest WHEN 'mean12' THEN w.mean12 ELSE f.casos::DOUBLE END AS median
            FROM fx_weeks w LEFT JOIN fx_state f ON f.uf = w.uf AND f.date = w.like_date, (VALUES ('naive'), ('seasonal'), ('mean12')) AS m(model))
        WHERE median IS NOT NULL AND sd IS NOT NULL""",
    "fx_tests": f"""
        SELECT uf, test, model, {score_sql(ALL_LEVELS)}
        FROM fx_ahead JOIN fx_state USING (uf, date) WHERE test <> 'final' GROUP BY uf, test, model""",
    "fx_results": """
        SELECT *, CASE WHEN model = 'naive' AND test = '1' THEN '' ELSE model || '/' || test END AS params FROM fx_tests""",
    "fx_profiles": """
        SELECT n_name AS state_uf, CAST(p.population AS DOUBLE) AS population, r_name AS climate_zone, b.biome, d.avg_cases,
               CASE WHEN d.peak >= 3.5 * d.avg_cases THEN 'epidemic' ELSE 'endemic' END AS historical_pattern
        FROM nation JOIN region ON n_regionkey = r_regionkey
        JOIN (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1) p ON p.c_nationkey = n_nationkey
        JOIN (SELECT c_nationkey, c_mktsegment AS biome,
                     row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS rn
              FROM customer GROUP BY 1, 2) b ON b.c_nationkey = n_nationkey AND b.rn = 1
        JOIN (SELECT uf, avg(casos) AS avg_cases, max(casos) AS peak FROM fx_state GROUP BY uf) d ON d.uf = n_name""",
    "fx_samples": f"""
        SELECT n_name AS uf, {SUNDAY.format('o_orderdate')} AS date, o_orderkey AS sample_id, o_totalprice AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fx_merged": """
        SELECT d.*, c.temp_min, c.temp_med, c.temp_max, c.precip_tot, c.rel_humid_med,
               CAST(year(d.date) AS INTEGER) AS year, p.population, e.koppen, e.biome
        FROM fx_flagged d LEFT JOIN fx_climate c USING (date, geocode, epiweek)
        LEFT JOIN fx_population p ON p.geocode = d.geocode AND p.year = year(d.date)
        LEFT JOIN fx_environ e ON e.geocode = d.geocode""",
    "fx_panel": """
        SELECT uf, date, epiweek, casos, temp_min, temp_med, temp_max, precip_tot, rel_humid_med, population,
               casos / population * 100000 AS incidence_rate
        FROM (SELECT uf, date, epiweek, CAST(sum(casos) AS BIGINT) AS casos, avg(temp_min) AS temp_min,
                     avg(temp_med) AS temp_med, avg(temp_max) AS temp_max, avg(precip_tot) AS precip_tot,
                     avg(rel_humid_med) AS rel_humid_med, CAST(sum(population) AS BIGINT) AS population
              FROM fx_merged GROUP BY uf, date, epiweek)""",
}


def with_tables(body: str) -> str:
    """``body`` preceded by the tables it mentions, in order of dependence."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in CTES and name not in wanted:
                visit(CTES[name])
                wanted.add(name)

    visit(body)
    used = [n for n in CTES if n in wanted]
    head = ", ".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in used)
    return f"WITH {head} {body}" if used else body
