import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boosting as b


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 900
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.round(np.where(x[:, 0] > 0.2, 4.0, 0.0) + np.where(x[:, 1] > -0.5, 1.5, 0.0) + rng.normal(size=n) * 0.5, 3)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    rows = [(*map(float, r), float(v), i) for i, (r, v) in enumerate(zip(x, y))]
    rows += [(None, float("nan"), 1.0, 2.0, 900), (0.0, 0.0, 0.0, None, 901)]
    return spark.createDataFrame(rows, "a double, b double, noise double, y double, i int").repartition(5)


def quantile(v, q):
    """The smallest value that a share q of the values does not exceed."""
    v = np.sort(v)
    return v[max(0, math.ceil(round(q * len(v), 9)) - 1)]


def brute(x, y, booster, cuts):
    """Boosting written from its definition, one node at a time."""
    bins = np.column_stack([np.where(np.isnan(x[:, f]), 0, [1 + sum(c < v for c in cuts[f]) for v in x[:, f]]) for f in range(x.shape[1])])
    told = np.full(len(y), quantile(y, booster.level))
    for _ in range(booster.rounds):
        add = np.zeros(len(y))

        def divide(rows, depth, add=add):
            gradient = np.where(y[rows] > told[rows], booster.level, booster.level - 1)
            best, found = 1e-9, None
            for f in range(x.shape[1] if depth else 0):
                for c in range(b.BINS):
                    left = bins[rows, f] <= c
                    if min(left.sum(), (~left).sum()) < booster.least:
                        continue
                    gain = gradient[left].sum() ** 2 / left.sum() + gradient[~left].sum() ** 2 / (~left).sum() - gradient.sum() ** 2 / len(rows)
                    if gain > best + 1e-9:
                        best, found = gain, left
            if found is None:
                add[rows] = booster.rate * quantile(y[rows] - told[rows], booster.level)
            else:
                divide(rows[found], depth - 1)
                divide(rows[~found], depth - 1)

        divide(np.arange(len(y)), booster.depth)
        told = told + add
    return told


def test_equals_boosting_by_brute_force(spark, table, data):
    x, y = data
    x = np.vstack([x, [np.nan, np.nan, 1.0]])
    y = np.r_[y, 2.0]
    boosters = [b.Booster(f"q{q}", q, rounds=4, depth=d, least=15) for q, d in ((0.1, 2), (0.5, 3), (0.9, 1))]
    model = b.fit(table, ["a", "b", "noise"], "y", boosters)
    got = {r.i: r._pred for r in b.predict(table, model, ["i"]).collect()}
    for k, booster in enumerate(boosters):
        want = brute(x, y, booster, model.cuts)
        assert np.allclose([got[i][k] for i in range(len(y))], want, atol=1e-9)


def test_results_do_not_depend_on_partitions_or_written_rounds(spark, table):
    boosters = [b.Booster("m", rounds=5, depth=2)]
    cuts = b.feature_cuts(table, ["a", "b", "noise"])
    rows = table.where("y is not null").withColumns({"_y": F.col("y"), "_day": F.lit(0)})
    trees = []
    for parts, refresh in ((1, 100), (7, 2)):
        binned = b.binned(rows.repartition(parts), ["a", "b", "noise"], cuts, ["_y", "_day"])
        trees.append(b.grow(binned, boosters, 3, refresh=refresh)[0].trees)
    for s, t in zip(*trees):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value)


def test_rows_after_a_cutoff_teach_nothing(spark, table):
    boosters = [b.Booster("early", until=400, rounds=3), b.Booster("late", until=901, rounds=3)]
    day = table.withColumn("day", F.date_from_unix_date("i"))
    changed = day.withColumn("y", F.when(F.col("i") > 400, F.col("y") * 10).otherwise(F.col("y")))
    one, two = (b.fit(t, ["a", "b"], "y", boosters, "day", cuts_until=400) for t in (day, changed))
    values = [[np.concatenate([t.value for t in m.ensembles[k].trees]) for m in (one, two)] for k in (0, 1)]
    assert np.array_equal(*values[0]) and not np.array_equal(*values[1])


def test_expression_walks_the_same_trees(spark, table):
    model = b.fit(table, ["a", "b", "noise"], "y", [b.Booster("m", rounds=6), b.Booster("n", 0.9, rounds=2, depth=1)])
    for k, e in enumerate(model.ensembles):
        walked = table.withColumn("walked", b.expression(model, e, F.array("a", "b", "noise")))
        told = b.predict(table, model, ["i"]).select("i", F.col("_pred")[k].alias("told"))
        assert walked.join(told, "i").where("abs(walked - told) > 1e-9 or walked is null").count() == 0


def test_importances(spark, table):
    model = b.fit(table, ["a", "b", "noise"], "y", [b.Booster(f"q{q}", q, rounds=6, depth=2) for q in (0.25, 0.5)])
    written = b.nodes(spark, model)
    gains = {r.feature: r.importance for r in b.gain_importances(written).collect()}
    written.createOrReplaceTempView("nodes")
    sql = spark.sql("""SELECT feature, sum(g / whole) / 2 AS importance FROM (SELECT booster, feature, sum(gain) AS g FROM nodes WHERE feature IS NOT NULL GROUP BY ALL)
                       JOIN (SELECT booster, sum(gain) AS whole FROM nodes GROUP BY booster) USING (booster) GROUP BY feature""")
    assert gains == pytest.approx({r.feature: r.importance for r in sql.collect()}) and sum(gains.values()) == pytest.approx(1)
    assert gains["a"] > gains["b"] > gains.get("noise", 0)
    moved = {r.feature: r.importance for r in b.permutation_importances(table, model, "y").collect()}
    assert moved["a"] > moved["b"] > abs(moved["noise"])


def test_recursion_equals_a_loop(spark):
    import datetime as dt

    rng = np.random.default_rng(9)
    rows = [(k, dt.date(2001, 1, 7) + dt.timedelta(weeks=i), float(rng.integers(0, 40))) for k, n in (("A", 90), ("B", 60), ("C", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "uf string, date date, casos double")
    lagged = [(rows[i - 1][2], float(np.mean([rows[i - j][2] for j in range(1, 5)])), rows[i][2]) for i in range(4, 90)]
    model = b.fit(spark.createDataFrame(lagged, "lag double, mean double, y double"), ["lag", "mean"], "y", [b.Booster("m", rounds=5, depth=2, least=5)])
    (tree,) = model.ensembles

    def value(past, date):
        mean = F.aggregate(F.slice(past, -4, 4), F.lit(0.0), lambda a, v: a + v) / 4
        return b.expression(model, tree, F.array(F.element_at(past, -1), mean))

    got = b.recursive(df, ["uf"], "date", "casos", 4, 52, value).orderBy("uf", "step").collect()
    for key, n in (("A", 90), ("B", 60)):
        past = [r[2] for r in rows if r[0] == key]
        for row in [r for r in got if r.uf == key]:
            x = np.array([[past[-1], np.mean(past[-4:])]])
            bins = np.column_stack([1 + np.searchsorted(c, x[:, f]) for f, c in enumerate(model.cuts)])
            past.append(tree.predict(bins)[0])
            assert row.median == pytest.approx(past[-1]) and row.date == dt.date(2001, 1, 7) + dt.timedelta(weeks=n - 1 + row.step)
        assert len(past) == n + 52
    assert [r.median for r in got if r.uf == "C"] == [None] * 52
