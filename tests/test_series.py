import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.operators import features as ft
from panelcast.operators.prep import carry_columns, fill_date_gaps, interpolate_columns
from panelcast.series import ROW_BITS, Series, in_order, numbered, over_chunks, positions

SMALL = Series(chunk_rows=16)


def frame(df):
    return df.toPandas().sort_values(["uf", "date"]).reset_index(drop=True)


def same(a, b):
    a, b = frame(a), frame(b)
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False)


def test_positions_number_every_row(panel):
    w = Window.partitionBy("uf").orderBy("date")
    want = panel.withColumn("_pos", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("uf")))
    same(positions(panel, SMALL), want)


@pytest.mark.parametrize("chunk", [7, 16, 64, 4096])
def test_chunked_frames_equal_whole_frames(panel, chunk):
    s = Series(chunk_rows=chunk)

    def build(w):
        return {
            **ft.lag_exprs(w, "casos", [1, 3, 7]),
            **ft.rolling_exprs(w, "casos", [2, 7], ["mean", "std", "min", "max", "median"]),
            **ft.diff_exprs(w, "casos", [4]),
            **ft.horizon_exprs(w, "casos", 5),
        }

    whole = Window.partitionBy("uf").orderBy("date")
    want = panel.select("*", *[c.alias(n) for n, c in build(whole).items()])
    same(over_chunks(panel, build, s, before=7, after=5), want)


def test_a_hot_series_is_cut_into_bounded_chunks(panel):
    """No window partition exceeds the chunk and its halo, though one series holds most rows."""
    sizes = over_chunks(
        panel, lambda w: {"rows": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))},
        Series(chunk_rows=32), before=8, after=4,
    )
    got = sizes.agg(F.max("rows").alias("most"), F.count("*").alias("n")).first()
    assert got.most <= 32 + 8 + 4 and got.n == panel.count()


def test_a_crowded_day_is_cut_too(spark, monkeypatch):
    """10,000 rows of one day in one series: many ranges, chunks within their bound, numbers as in one window."""
    rows = spark.range(10_200).select(
        F.lit("A").alias("uf"), F.date_add(F.lit("2020-01-01").cast("date"), F.greatest(F.col("id") - 9_999, F.lit(0)).cast("int")).alias("date"), "id"
    )
    s = Series(chunk_rows=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = in_order(rows, s).groupBy(F.shiftright("_row", ROW_BITS)).count().agg(F.max("count")).first()[0]
        ranged = positions(rows, s)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranges < 0.4 * 10_200
    one = Window.partitionBy("uf").orderBy("date", F.xxhash64(*rows.columns))
    whole = rows.withColumn("_pos", F.row_number().over(one)).withColumn("_n", F.lit(10_200))
    assert sorted(map(tuple, ranged.select("id", "_pos", "_n").collect())) == sorted(map(tuple, whole.select("id", "_pos", "_n").collect()))
    assert sorted(r._pos for r in ranged.collect()) == list(range(1, 10_201))
    monkeypatch.setattr("panelcast.series.positions", lambda df, s: ranged)
    size = lambda w: {"rows": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "three_back": F.lag("id", 3).over(w)}
    got = over_chunks(rows, size, s, before=3)
    assert got.agg(F.max("rows")).first()[0] <= 503
    want = ranged.withColumn("want", F.lag("id", 3).over(Window.partitionBy("uf").orderBy("_pos")))
    assert got.join(want.select("id", "want"), "id").where(~F.col("three_back").eqNullSafe(F.col("want"))).isEmpty()


def test_only_counted_rows_advance_the_number(spark):
    rows = [("A", i, i % 3 == 0) for i in range(50)] + [("B", 7, False), (None, 1, True), ("B", None, True)]
    s = Series(time="at")
    got = numbered(in_order(spark.createDataFrame(rows, "uf string, at int, flag boolean"), s), s, F.col("flag")).collect()
    assert sorted((r.uf, r.at, r._pos, r._n) for r in got) == [("A", i, i // 3 + 1, 17) for i in range(50)] + [("B", 7, 0, 0)]


def test_rolling_never_sees_the_current_row(panel):
    changed = panel.withColumn("casos", F.when(F.col("date") == "2003-01-05", F.lit(9999)).otherwise(F.col("casos")))
    a = frame(ft.rolling_features(panel, windows=[4], s=SMALL))
    b = frame(ft.rolling_features(changed, windows=[4], s=SMALL))
    cols = [c for c in a if "_roll_" in c]
    upto = a["date"] <= pd.Timestamp("2003-01-05").date()
    pd.testing.assert_frame_equal(a.loc[upto, cols], b.loc[upto, cols])


def test_results_do_not_depend_on_partitions(panel, spark):
    a = ft.lag_features(panel.repartition(1), lags=[1, 52], s=SMALL)
    b = ft.lag_features(panel.repartition(7, "casos"), lags=[1, 52], s=SMALL)
    same(a, b)


def test_fill_matches_pandas(panel):
    got = frame(carry_columns(panel, ["x"], SMALL))
    want = frame(panel)
    want["x"] = want.groupby("uf")["x"].transform(lambda v: v.ffill().bfill())
    pd.testing.assert_frame_equal(got, want)


def test_interpolation_matches_pandas(panel):
    got = frame(interpolate_columns(panel, ["x"], SMALL))
    want = frame(panel)
    want["x"] = want.groupby("uf")["x"].transform(lambda v: v.interpolate(method="linear"))
    pd.testing.assert_frame_equal(got, want)


def test_gap_filling_makes_weekly_calendars(panel):
    got = frame(fill_date_gaps(panel.select("uf", "date", "casos")))
    for _, g in got.groupby("uf"):
        steps = pd.to_datetime(g["date"]).diff().dropna().dt.days
        assert (steps == 7).all()
    kept = got.dropna(subset=["casos"])
    assert len(kept) == panel.count()


def test_gap_filling_keeps_rows_off_the_calendar(spark):
    import datetime as dt

    rows = [("A", dt.date(2020, 1, 5), 202001, 1), ("A", dt.date(2020, 1, 13), 202003, 2), ("A", dt.date(2020, 1, 14), 202003, 3), ("A", dt.date(2020, 1, 26), 202004, 4), ("B", None, 1, 1)]
    got = fill_date_gaps(spark.createDataFrame(rows, "uf string, date date, epiweek int, casos int")).orderBy("date").collect()
    assert [(r.date.day, r.casos) for r in got] == [(5, 1), (13, 2), (14, 3), (19, None), (26, 4)]
    assert got[3].epiweek == 202003
