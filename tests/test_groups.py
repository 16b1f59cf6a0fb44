import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.operators.ensemble import conformal_level
from panelcast.operators.groups import attach, column_quantiles, first_per_group, group_quantiles, top_per_group

LEVELS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    n = 30_000
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "heavy": rng.pareto(0.3, n)}[kind]
    # one group holds most rows
    key = np.where(rng.random(n) < 0.9, "hot", "cold")
    df = spark.createDataFrame([(k, float(v)) for k, v in zip(key, x)], "k string, x double")
    # a coarse sketch, so that the narrowing is real
    got = {r.k: r for r in group_quantiles(df, ["k"], "x", LEVELS, accuracy=1000).collect()}
    for k in ("hot", "cold"):
        for name, p in LEVELS.items():
            assert got[k][name] == pytest.approx(np.quantile(x[key == k], p), rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.floats(0, 1))
def test_quantile_of_any_list(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = group_quantiles(df, [], "x", {"q": p}).first().q
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_quantiles_of_several_columns_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0), ("b", None, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in column_quantiles(df, ["k"], ["x", "y"], {"m": 0.5}).collect()}
    assert (got["a"].m_x, got["a"].m_y) == (2.0, 5.0)
    assert (got["b"].m_x, got["b"].m_y) == (None, 2.0)


def test_nan_is_left_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,)], "x double")
    assert group_quantiles(df, [], "x", {"q": 1.0}).first().q == 2.0


def test_level_may_depend_on_group_size(spark):
    x = list(range(1, 41))
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = group_quantiles(df, [], "x", {"q": 0.8}, conformal_level).first().q
    assert got == pytest.approx(np.quantile(x, np.ceil(41 * 0.8) / 40))


def test_attach_keeps_rows_and_matches_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("z", 3)], "k string, i int")
    stats = spark.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    got = {r.i: r.v for r in attach(rows, stats, ["k"], ["i"]).collect()}
    assert got == {1: 10, 2: 20, 3: None}


def test_first_and_top(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in first_per_group(df, ["k"], [F.col("v")]).collect()} == {("a", 1), ("b", 2)}
    assert [r["rank"] for r in top_per_group(df, ["k"], [F.col("v")], 2).orderBy("k", "rank").collect()] == [1, 2, 1]


def test_conformal_levels_of_a_large_group(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=60_000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = group_quantiles(df, [], "x", {"all": 1.0, "most": 0.95}, conformal_level).first()
    assert got.all == pytest.approx(np.quantile(x, 0.999), rel=1e-9)
    assert got.most == pytest.approx(np.quantile(x, min(1.0, np.ceil(60_001 * 0.95) / 60_000)), rel=1e-9)


def test_only_the_cells_with_the_rank_are_ordered(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("k"), F.hash("id").cast("double").alias("x"))
    got = group_quantiles(df, ["k"], "x", {"q": 0.5})
    assert got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the ordering window is within a cell of a bracket
    assert "_cell" in plan[plan.index("Window"):]


def test_quantiles_of_one_value_and_of_infinities(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [("b", float("inf"))] * 3 + [("c", None)], "k string, x double")
    got = {r.k: r.q for r in group_quantiles(df, ["k"], "x", {"q": 0.3}).collect()}
    assert got == {"a": 2.0, "b": float("inf")}


@pytest.mark.parametrize("kind", ["heavy", "steps", "spike"])
def test_groups_are_narrowed_until_they_are_small(spark, monkeypatch, kind):
    """Several rounds of narrowing, also where nearly all values lie in one corner of a bracket."""
    from panelcast.operators import groups

    monkeypatch.setattr(groups, "GROUP", 60)
    rng = np.random.default_rng(6)
    n = 40_000
    x = {"heavy": np.exp(30 * rng.random(n) ** 8), "steps": np.floor(rng.pareto(0.5, n)), "spike": np.where(rng.random(n) < 0.7, 5.0, rng.normal(size=n))}[kind]
    key = np.where(rng.random(n) < 0.95, "hot", np.where(rng.random(n) < 0.98, "cold", None))
    df = spark.createDataFrame([(k, float(v)) for k, v in zip(key, x)], "k string, x double")
    levels = {**LEVELS, "low": 0.001, "high": 0.9999}
    got = {r.k: r for r in group_quantiles(df, ["k"], "x", levels, accuracy=500).collect()}
    for k in ("hot", "cold", None):
        for name, p in levels.items():
            assert got[k][name] == pytest.approx(np.quantile(x[key == k], p), rel=1e-12)
