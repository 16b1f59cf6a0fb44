import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from panelcast.functions import reference
from panelcast.operators import merge
from panelcast.operators.seasons import assign_seasons
from panelcast.plans import selection as v
from panelcast.plans import submission as sub
from panelcast.sources import readers, sinks

WEIGHT = {"climate_zone": 0.3, "biome": 0.3, "historical_pattern": 0.2}


def brute_force(rows, n, population, proven):
    out = {}
    for a in rows:
        scored = []
        for b in rows:
            if a[0] == b[0]:
                continue
            s = sum(w for i, w in zip((2, 3, 6), WEIGHT.values()) if a[i] == b[i])
            if population:
                s += 0.2 * min(a[1], b[1]) / max(a[1], b[1])
            scored.append((-round(s * (1.2 if b[0] in proven else 1), 9), b[0]))
        out[a[0]] = [name for _, name in sorted(scored)[:n]]
    return out


@pytest.mark.parametrize("population", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_similar_states_equal_all_pairs(spark, population, seed):
    rnd = random.Random(seed)
    rows = [
        (f"S{i:02d}", float(rnd.randint(1, 1000)), rnd.choice("xyz"), rnd.choice("pq"), 1.0, "summer", rnd.choice("ee f".split()))
        for i in range(40)
    ]
    profiles = spark.createDataFrame(rows, reference.state_profiles(spark).schema)
    proven = {r[0] for r in rows if rnd.random() < 0.4}
    known = spark.createDataFrame([(p,) for p in proven], "state_uf string")
    criteria = ("climate", "biome", "pattern") + (("population",) if population else ())
    got: dict = {}
    for r in v.similar_states(profiles, 3, criteria, known).orderBy("state_uf", "rank").collect():
        got.setdefault(r.state_uf, []).append(r.similar_uf)
    assert got == brute_force(rows, 3, population, proven)


@pytest.mark.parametrize("populations", [[7.0], [3.0, 4.0, 400.0]])
def test_similar_states_of_equal_populations_equal_all_pairs(spark, populations):
    rnd = random.Random(3)
    rows = [(f"S{i:02d}", rnd.choice(populations), rnd.choice("xy"), "p", 1.0, "summer", "e") for i in range(60)]
    rnd.shuffle(rows)
    profiles = spark.createDataFrame(rows, reference.state_profiles(spark).schema)
    proven = {r[0] for r in rows if rnd.random() < 0.2}
    known = spark.createDataFrame([(p,) for p in proven], "state_uf string")
    found: dict = {}
    for r in v.similar_states(profiles, 3, ("climate", "population"), known).orderBy("state_uf", "rank").collect():
        found.setdefault(r.state_uf, []).append(r.similar_uf)
    # biome and pattern are not among the criteria: make them differ
    apart = [(*r[:3], f"b{i}", *r[4:6], f"h{i}") for i, r in enumerate(rows)]
    assert found == brute_force(apart, 3, True, proven)


def test_fixed_tables(spark):
    assert reference.state_codes(spark).count() == 27
    edges = reference.neighbour_edges(spark)
    assert edges.count() == 103
    back = edges.select(F.col("neighbor").alias("uf"), F.col("uf").alias("neighbor"))
    one_way = {tuple(r) for r in edges.exceptAll(back).collect()}
    assert one_way == {("PE", "SE")}


def test_windows_overlap_on_their_shared_day(spark):
    df = spark.createDataFrame([(dt.date(2023, 10, 8),), (dt.date(2022, 7, 3),)], "date date")
    got = {(str(r.date), r.test, r.role) for r in assign_seasons(df).collect()}
    assert {("2023-10-08", "1", "target"), ("2023-10-08", "2", "target"), ("2023-10-08", "3", "train")} <= got
    assert ("2022-07-03", "1", "train") not in got


def test_unknown_state_code(spark):
    df = spark.createDataFrame([(3550308,), (9900000,)], "geocode int")
    codes = reference.state_codes(spark)
    assert {r.geocode: r.state for r in merge.state_from_geocode(df, codes).collect()} == {3550308: "SP", 9900000: None}
    with pytest.raises(Exception, match="unknown state code"):
        merge.state_from_geocode(df, codes, strict=True).collect()


def test_missing_population_stays_missing(spark):
    d = dt.date(2025, 1, 5)
    dengue = spark.createDataFrame([(d, 202501, 1, "SP", 4)], "date date, epiweek int, geocode int, uf string, casos bigint")
    population = spark.createDataFrame([(1, 2023, 100), (1, 2024, 200)], "geocode int, year int, population bigint")
    got = merge.aggregate_to_state(merge.merge_sources(dengue, population=population)).first()
    assert got.population is None and got.incidence_rate is None
    got = merge.aggregate_to_state(merge.merge_sources(dengue, population=population, carry_population=True)).first()
    assert got.incidence_rate == pytest.approx(4 / 200 * 1e5)


def documents(spark):
    rows = [("SP", dt.date(2025, 1, 12), 5.0, 6.0, 7.0), ("SP", dt.date(2025, 1, 5), -1.0, -2.0, 3.0), ("RJ", dt.date(2025, 1, 5), 2.0, 1.0, 0.5)]
    return spark.createDataFrame(rows, "uf string, date date, median double, lower_50 double, upper_50 double")


def test_documents_and_back(spark):
    docs = sub.format_forecasts(documents(spark), predict_date="2025-01-01")
    sp = docs.where("adm_1 = 'SP'").first().prediction
    assert list(sp.dates) == ["2025-01-05", "2025-01-12"] and list(sp.preds) == [0.0, 5.0] and list(sp.lower_50) == [0.0, 6.0]
    rows = {(r.adm_1, r.date): r["median"] for r in sub.to_rows(docs).collect()}
    assert rows == {("SP", "2025-01-05"): 0.0, ("SP", "2025-01-12"): 5.0, ("RJ", "2025-01-05"): 2.0}
    again = sub.format_forecasts(sub.to_rows(docs).select(F.col("adm_1").alias("uf"), F.to_date("date").alias("date"), "median", "lower_50", "upper_50"), predict_date="2025-01-01")
    assert sorted(map(str, again.collect())) == sorted(map(str, docs.collect()))


def test_document_issues(spark):
    docs = sub.format_forecasts(documents(spark))
    assert {tuple(r) for r in sub.validate_documents(docs).collect()} == {("RJ", "lower_50 > upper_50", 0)}
    bad = docs.limit(1).select("adm_1", F.struct(F.array().cast("array<string>").alias("dates"), F.array(F.lit(1.0)).alias("preds"), F.array(F.lit(-1.0)).alias("lower_50")).alias("prediction"))
    issues = {r.issue for r in sub.validate_documents(bad).collect()}
    assert issues == {"No dates provided", "Dates and predictions length mismatch", "Negative values in lower_50"}
    with pytest.raises(ValueError):
        sub.format_forecasts(documents(spark).drop("median"))


def write(path, text):
    with (gzip.open(path, "wt") if str(path).endswith(".gz") else open(path, "w")) as f:
        f.write(text)


def test_raw_files(spark, tmp_path):
    write(tmp_path / "dengue.csv.gz", "date,epiweek,geocode,uf,casos,train_1,target_1,extra\n2020-01-05,202001,3550308,SP,7.0,True,False,q\n2020-01-12,202002,3550308,SP,,True,False,q\n")
    write(tmp_path / "map_regional_health.csv", "geocode,region\n3550308,East\n")
    rows = readers.scan_dengue(spark, str(tmp_path)).orderBy("date").collect()
    assert [(str(r.date), r.epiweek, r.geocode, r.casos, r.train_1, r.extra) for r in rows] == [
        ("2020-01-05", 202001, 3550308, 7, True, "q"), ("2020-01-12", 202002, 3550308, 0, True, "q")]
    assert readers.scan_regional_map(spark, str(tmp_path)).first().region == "East"
    assert readers.scan_ocean(spark, str(tmp_path)).columns == ["date", "enso", "iod", "pdo"]
    assert readers.scan_ocean(spark, str(tmp_path)).isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.scan_climate(spark, str(tmp_path)).collect()
    found = {r.table: r.present for r in readers.source_inventory(spark, str(tmp_path)).collect()}
    assert found["dengue"] and not found["climate"] and len(found) == len(reference.SOURCE_FILES)


def test_cache_sees_every_row(spark, tmp_path):
    cache = sinks.FeatureCache(spark, str(tmp_path / "cache"))
    df = spark.range(3000).withColumn("v", F.col("id") * 2)
    calls = []

    def compute(x):
        calls.append(1)
        return x.withColumn("w", F.col("v") + 1)

    cache.get_or_compute(df, compute, {"a": 1})
    assert cache.get_or_compute(df.repartition(5), compute, {"a": 1}).count() == 3000 and len(calls) == 1
    late = df.withColumn("v", F.when(F.col("id") == 2999, 0).otherwise(F.col("v")))
    cache.get_or_compute(late, compute, {"a": 1})
    cache.get_or_compute(df, compute, {"a": 2})
    assert len(calls) == 3
    assert cache.info().count() == 3
    cache.clear(sinks.cache_key(df, {"a": 1}))
    assert cache.get(sinks.cache_key(df, {"a": 1})) is None


def test_normal_plot_matches_sorted_residuals(spark):
    from statistics import NormalDist

    from panelcast.plans.report import normal_qq

    rnd = random.Random(4)
    values = [round(rnd.gauss(0, 3), 1) for _ in range(500)]
    df = spark.createDataFrame([("m", v_) for v_ in values], "model string, residual double")
    got = normal_qq(df, ["model"], cells=8).orderBy("rank").collect()
    n = len(values)
    assert [r.ordered for r in got] == sorted(values) and [r["rank"] for r in got] == list(range(1, n + 1))
    assert got[0].theoretical == pytest.approx(NormalDist().inv_cdf(1 - 0.5 ** (1 / n)))
    assert got[99].theoretical == pytest.approx(NormalDist().inv_cdf((100 - 0.3175) / (n + 0.365)))


def test_convergence_stops_and_keeps_the_best(spark):
    scores = [10, 9, 9, 9, 9, 9, 9, 1]
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(scores)], "uf string, i int, score double")
    row = v.convergence(df, ("uf",), "i", patience=3, min_iterations=2).first()
    assert (row.best_score, row.iterations, row.converged) == (9.0, 5, True)
    row = v.convergence(df, ("uf",), "i", patience=20).first()
    assert (row.best_score, row.iterations, row.converged) == (1.0, 8, False)


def _weekly(spark, changed=False):
    import datetime as dt
    import random

    rnd = random.Random(3)
    start = dt.date(2001, 1, 7)
    rows = [(u, start + dt.timedelta(weeks=i), rnd.randint(0, 40)) for u in ("A", "B") for i in range(170)]
    if changed:
        rows = [(u, d, c if d <= dt.date(2003, 1, 5) else c + 1000) for u, d, c in rows]
    return spark.createDataFrame(rows, "uf string, date date, casos bigint")


def test_forecasts_of_a_season_know_nothing_after_training(spark):
    from panelcast.plans.backtest import season_forecasts

    seasons = [("1", "x", "2003-01-05", "2003-03-02", "2004-02-22"), ("final", "y", "2003-01-05", "2009-01-04", "2009-12-27")]
    before = sorted(season_forecasts(_weekly(spark), seasons).collect())
    after = sorted(season_forecasts(_weekly(spark, changed=True), seasons).collect())
    assert before == after
    # every week of both windows, observed or not; no week in 2009 is like one in the last training year
    assert len({r.date for r in before if r.test == "1"}) == 52
    assert {r.model for r in before if r.test == "final"} == {"naive", "seasonal", "mean12"}


def test_reasons_follow_from_strengths():
    from panelcast.plans.selection import reasons

    assert reasons("xgboost") == ["handles seasonality well", "captures trend patterns"]
    assert reasons("prophet") == ["handles seasonality well"]
    assert reasons("tft") == ["highly interpretable"]
    assert reasons("nbeats") == ["handles seasonality well", "captures trend patterns"]
    assert reasons("lstm") == []


def test_every_qualifying_model_is_listed(spark):
    from panelcast.plans.selection import qualifying_models, select_top_models

    rows = [("A", f"m{i}", t, 1.0 + i, 1.0, 1.0, 1.0, 1.0, 0.0, 0.95, 0.8, 0.5) for i in range(12) for t in "123"]
    names = "uf string, model string, test string, crps double, wis_total double, rmse double, mae double, mape double, bias double, coverage_95 double, coverage_80 double, coverage_50 double"
    table = spark.createDataFrame(rows, names)
    assert qualifying_models(table).count() == 12
    assert select_top_models(table).count() == 3


def test_normal_quantiles_as_columns(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from panelcast.plans.report import with_normal_quantile

    ps = [1e-300, 1e-12, 1e-5, 0.02, 0.075, 0.0751, 0.3, 0.5, 0.7, 0.9249, 0.925, 0.99, 1 - 1e-9]
    got = with_normal_quantile(spark.createDataFrame([(p,) for p in ps], "p double"), F.col("p"), "q").collect()
    for r in got:
        assert abs(r.q - NormalDist().inv_cdf(r.p)) <= 1e-12 * max(1, abs(r.q))


def test_files_of_a_folder_follow_its_size(spark, tmp_path):
    rows = [("A", "hot", dt.date(2001, 1, 7) + dt.timedelta(days=i), float(i)) for i in range(400)]
    rows += [("A", "small", dt.date(2001, 1, 7) + dt.timedelta(days=i), float(i)) for i in range(9)] + [("B", None, dt.date(2001, 1, 7), 1.0)]
    df = spark.createDataFrame(rows, "uf string, model string, date date, median double")
    path = str(tmp_path / "forecasts")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        sinks.write_forecasts(df, path, file_rows=50)
    finally:
        spark.conf.set(coalesce, before)
    files = {k: len(list((tmp_path / "forecasts").glob(f"*/model={k}/*.csv"))) for k in ("hot", "small")}
    assert files["hot"] > 2 and files["small"] == 1
    got = sinks.read_forecasts(spark, path, df.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    assert sorted((r.uf, r.model or "", r.date, r["median"]) for r in got.collect()) == sorted((a, b or "", c, d) for a, b, c, d in rows)
    sinks.write_forecasts(df.limit(0), str(tmp_path / "none"))
