"""Group-level results joined back to rows, and exact quantiles of large groups."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

SKETCH_ACCURACY = 10_000
# steps of the ladder of a group's values
STEPS = 1024
# values that one task sorts for a group
GROUP = 10_000


def attach(df: DataFrame, stats: DataFrame, on: list[str], spread: list[str], salts: int = 16) -> DataFrame:
    """Left join ``stats`` (one row per ``on``) to the rows of ``df``.

    Spark broadcasts ``stats`` when it measures it small. When it does not, a shuffle on
    ``on`` alone would send all rows of a hot group to one task, so the group is split
    over ``salts`` by the hash of the ``spread`` columns.
    """
    if not on:
        on, df, stats = ["_one"], df.withColumn("_one", F.lit(1)), stats.withColumn("_one", F.lit(1))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # keys may be null on either side: match them null-safely
    right = copies.select(
        *[F.col(c).alias(f"_k_{c}") for c in on],
        F.col("_salt").alias("_k_salt"),
        *[c for c in stats.columns if c not in on],
    )
    condition = F.col("_salt") == F.col("_k_salt")
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = salted.join(right, condition, "left")
    return joined.drop("_salt", "_k_salt", "_one", *[f"_k_{c}" for c in on])


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    levels: dict[str, float],
    level_of: Callable[[Column, float], Column] | None = None,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group and one column per level.
    NULL and NaN are left out.

    Spark's ``percentile`` holds every distinct value of a group in one task. Here a group of up to
    ``GROUP`` values is one sorted array. Of a larger one, a mergeable sketch gives a bracket around each
    wanted rank; rows below and inside the bracket are counted, and only those inside go on, as a group of
    their own, which is narrowed in the same way until it is small. Brackets are cut by rank, so heavy
    tails are no different. The counts are exact, so the result is; the sketch only decides how little has
    to be ordered. Keys and values are written once, and sizes are looked up while the plan is made.

    ``level_of(n, p)`` may adjust the level to the group size ``n``.
    """
    names = list(levels)
    rows = cut_lineage(df.select(*keys, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")))

    def rank_of(name: str, n: Column) -> Column:
        p = F.lit(float(levels[name])) if level_of is None else level_of(n, float(levels[name]))
        return (n - 1) * p

    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    least, largest = sizes.agg(F.min("_n"), F.max("_n")).first()
    largest = largest or 0
    sized = rows if largest <= GROUP or least > GROUP else attach(rows, sizes, keys, ["_x"])
    small = sized if largest <= GROUP else sized.where(F.col("_n") <= GROUP) if least <= GROUP else None
    out = None
    if small is not None:
        whole = small.groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_s"))
        at = lambda r: F.get("_s", r.cast("int"))
        picks = {name: rank_of(name, F.size("_s")) for name in names}
        # without keys, no rows at all give no result rather than a row of nulls
        out = whole.where(F.size("_s") > 0).select(*keys, *[_interpolated(at(F.floor(r)), at(F.ceil(r)), r).alias(name) for name, r in picks.items()])
    if largest <= GROUP:
        return out
    ranks = F.array(*[F.struct(F.lit(i).alias("id"), rank_of(name, F.col("_n")).alias("rank")) for i, name in enumerate(names)])
    large = rows if least > GROUP else sized.where(F.col("_n") > GROUP).select(*keys, "_x")
    found = _at_ranks(large, keys, _shape(large, keys, accuracy).withColumn("_ranks", ranks), accuracy, len(names))
    value_at = _interpolated(F.col("_v0"), F.col("_v1"), F.col("rank"))
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("id") == i, value_at)).alias(name) for i, name in enumerate(names)])
    return found if out is None else out.unionByName(found)


def _interpolated(low: Column, high: Column, rank: Column) -> Column:
    # equal ends need no interpolation, which would turn an infinite value into NaN
    return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank)))


def _shape(rows: DataFrame, keys: list[str], accuracy: int) -> DataFrame:
    """Size of every group and its values at equal steps of rank, by a sketch."""
    ladder = [i / STEPS for i in range(STEPS + 1)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_x", ladder, accuracy).alias("_ladder"))


def _at_ranks(rows: DataFrame, keys: list[str], wanted: DataFrame, accuracy: int, width: int) -> DataFrame:
    """The values at the floor and the ceiling of each of ``width`` ranks (from 0): keys, id, rank, ``_v0``, ``_v1``.

    ``wanted`` has per group its size, ladder and array ``_ranks`` of (id, rank). Other groups of ``rows`` are
    left out.
    """
    n = F.col("_n")
    wanted = cut_lineage(wanted)
    for slack in (4.0 / accuracy, 64.0 / accuracy, 1.0):

        def bracket(r: Column) -> Column:
            below = F.floor((F.floor(r["rank"]) / n - slack) * STEPS).cast("int")  # noqa: B023
            above = F.ceil(((F.ceil(r["rank"]) + 1) / n + slack) * STEPS).cast("int")  # noqa: B023
            lo = F.when(below > 0, F.get("_ladder", below)).otherwise(float("-inf"))
            hi = F.when(above < STEPS, F.get("_ladder", above)).otherwise(float("inf"))
            return F.struct(r["id"].alias("id"), r["rank"].alias("rank"), lo.alias("lo"), hi.alias("hi"))

        brackets = wanted.select(*keys, F.transform("_ranks", bracket).alias("_b"))
        placed = attach(rows, brackets, keys, ["_x"]).where("_b is not null")
        ids = range(width)
        b, x = F.col("_b"), F.col("_x")
        counted = placed.groupBy(*keys).agg(
            F.array(*[F.count_if(x < b[i]["lo"]) for i in ids]).alias("_below"),
            F.array(*[F.count_if((x >= b[i]["lo"]) & (x <= b[i]["hi"])) for i in ids]).alias("_inside"),
        )
        counted = attach(brackets, counted, keys, ["_b"], salts=1)
        cells = cut_lineage(counted.select(*keys, F.inline(F.arrays_zip("_b", "_below", "_inside"))).select(*keys, "_b.*", "_below", "_inside"))
        # a bracket that misses its rank, which a sketch should not make, is made again wider
        missed, largest = cells.agg(
            F.count_if((F.col("_below") > F.floor("rank")) | (F.ceil("rank") >= F.col("_below") + F.col("_inside"))),
            F.max(F.when(F.col("lo") < F.col("hi"), F.col("_inside"))),
        ).first()
        if not missed:
            break
    one = cells.where("lo = hi").select(*keys, "id", "rank", F.col("lo").alias("_v0"), F.col("lo").alias("_v1"))
    if largest is None:
        return one
    # brackets in brackets, each under a name of its own
    cell = "_cell" + "_" * sum(k.startswith("_cell") for k in keys)
    inner = [*keys, cell]
    inside = F.filter("_b", lambda c: (c["lo"] < c["hi"]) & (F.col("_x") >= c["lo"]) & (F.col("_x") <= c["hi"]))
    within = cut_lineage(placed.select(*keys, "_x", F.explode(F.transform(inside, lambda c: c["id"])).alias(cell)))
    left = cells.where("lo < hi").select(*keys, F.col("id").alias(cell), F.col("rank").alias("_whole"), (F.col("rank") - F.col("_below")).alias("rank"), "_inside")
    # copies of a value are counted before they travel; what is ordered is different values
    values = within.groupBy(*inner, "_x").agg(F.count(F.lit(1)).alias("_c"))
    if largest > GROUP:
        values = cut_lineage(values)
        largest = values.groupBy(*inner).count().agg(F.max("count")).first()[0]
    if largest <= GROUP:
        upto = F.sum("_c").over(Window.partitionBy(*inner).orderBy("_x"))
        picked = attach(values.withColumn("_upto", upto), left, inner, ["_x"])
        value = lambda r: F.max(F.when((F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto")), F.col("_x")))
        found = picked.groupBy(*inner, "_whole").agg(value(F.floor("rank")).alias("_v0"), value(F.ceil("rank")).alias("_v1"))
    else:
        again = cut_lineage(_shape(within, inner, accuracy)).alias("s")
        ranks = left.select(*[F.col(c).alias(f"_k_{c}") for c in inner], "_whole", F.array(F.struct(F.lit(0).alias("id"), F.col("rank"))).alias("_ranks"))
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in inner]
        joined = again.join(ranks, reduce(lambda p, q: p & q, same)).select(*inner, "_n", "_ladder", "_ranks", "_whole")
        deeper = _at_ranks(within, inner, joined, accuracy, 1)
        found = attach(deeper.drop("rank", "id"), left.select(*inner, "_whole"), inner, ["_v0"])
    return found.select(*keys, F.col(cell).alias("id"), F.col("_whole").alias("rank"), "_v0", "_v1").unionByName(one)


def column_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], levels: dict[str, float]
) -> DataFrame:
    """``group_quantiles`` of several columns in one go, as ``<level>_<column>``."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_value")) for c in columns]
    )
    long = df.select(*keys, F.inline(cells))
    found = group_quantiles(long, [*keys, "_col"], "_value", levels)
    return found.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("_col") == c, F.col(name))).alias(f"{name}_{c}")
            for c in columns
            for name in levels
        ]
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order.

    Spark keeps one row per group and task before the shuffle, so copies of a hot key
    never travel together.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their 1-based ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
