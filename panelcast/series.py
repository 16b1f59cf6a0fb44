"""Window computation over long series without putting a series in one task.

A panel has one row per ``(key, time)``. ``Window.partitionBy(key)`` would send all
rows of one key to one task, so a single hot key sets the run time of the job. Here a
series is cut into chunks of at most ``chunk_rows`` consecutive rows, and every chunk
carries a halo: the rows just before and after it that its frames reach into. The
chunks of one series run in different tasks and the results are those of the uncut
series.

Cutting by row count needs the row number of each row in its series. The rows are sorted
across tasks by series and time, by ranges that Spark draws from a sample, so a hot series,
and even one point in time of it, lies in many ranges; rows of equal time come by ``order``
and then by a hash of all their columns. A row's number is its place in its range plus the
rows of its series in the ranges before. Rows without key or time belong to no series and
are left out.

The sorted rows are written (``session.cut_lineage``), so that numbers and rows agree when a
task runs again. Drawing the ranges reads the input once more, so an expensive input, such as
a roll-up of raw tables, should be written first too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

# monotonically increasing ids hold the partition above this many bits
ROW_BITS = 33


@dataclass(frozen=True)
class Series:
    """How rows form series, and how finely series are cut."""

    key: tuple[str, ...] = ("uf",)
    time: str = "date"
    chunk_rows: int = 4096
    order: tuple[str, ...] = ()


def in_order(df: DataFrame, s: Series = Series()) -> DataFrame:
    """The rows that belong to series, written in order with ``_row``, which grows in that order."""
    known = [F.col(c).isNotNull() for c in (*s.key, s.time)]
    place = [*s.key, s.time, *s.order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    rows = df.where(reduce(lambda a, b: a & b, known)).repartitionByRange(*place).sortWithinPartitions(*place)
    return cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))


def numbered(ordered: DataFrame, s: Series = Series(), counted: Column | None = None) -> DataFrame:
    """Rows of ``in_order`` with ``_pos`` (1-based row number in the series) and ``_n`` (series length).

    With a condition ``counted`` only rows meeting it advance the number.
    """
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    placed = ordered.withColumn("_part", F.shiftright("_row", ROW_BITS))
    spans = placed.groupBy(*s.key, "_part").agg(F.min("_row").alias("_first"), F.sum(one).alias("_c"))
    whole = Window.partitionBy(*s.key)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        *s.key,
        "_part",
        "_first",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_c").over(whole).alias("_n"),
    )
    here = F.col("_row") - F.col("_first") + 1
    if counted is not None:
        in_part = Window.partitionBy(*s.key, "_part").orderBy("_row")
        here = F.sum(one).over(in_part.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.join(offsets, [*s.key, "_part"])
        .withColumn("_pos", F.col("_off") + here)
        .drop("_row", "_part", "_first", "_off")
    )


def positions(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Add ``_pos`` (1-based row number in the series) and ``_n`` (series length)."""
    return numbered(in_order(df, s), s)


def over_chunks(
    df: DataFrame,
    build: Callable[[Window], dict[str, Column]],
    s: Series = Series(),
    before: int = 0,
    after: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Add the columns ``build(window)``, whose frames reach ``before`` rows back and
    ``after`` rows ahead. ``keep`` names helper columns (``_pos``, ``_n``) to retain."""
    size = max(s.chunk_rows, before, after)
    index = F.col("_pos") - 1
    home = F.floor(index / F.lit(size))
    inside = index - home * size
    in_next = (inside >= size - before) & ((home + 1) * size < F.col("_n"))
    in_previous = (inside < after) & (home > 0)
    copies = F.array_compact(
        F.array(home, F.when(in_next, home + 1), F.when(in_previous, home - 1))
    )
    cut = positions(df, s).withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(*s.key, "_chunk").orderBy("_pos")
    added = build(window)
    kept = [c for c in df.columns if c not in added]
    return (
        cut.select("*", *[expr.alias(f"_new_{name}") for name, expr in added.items()])
        .where(F.col("_chunk") == F.col("_home"))
        .select(
            *kept,
            *[F.col(f"_new_{name}").alias(name) for name in added],
            *keep,
        )
    )


def nearest_in_series(
    df: DataFrame, columns: list[str], s: Series = Series(), at: str | None = None
) -> DataFrame:
    """Add ``_before_<c>`` and ``_after_<c>``: the nearest non-null ``(at, x)`` at or
    before, and at or after, each row. ``at`` orders the series; its time by default.

    The frames are unbounded, so halos do not apply. Each block of ``chunk_rows`` rows is
    summed up by its first and last non-null value, those are carried across blocks, and
    inside a block a window does the rest. Rows that have ``_pos`` are not numbered again.
    """
    at = at or s.time
    placed = df if "_pos" in df.columns else positions(df, s)
    blocked = placed.withColumn("_blk", F.floor((F.col("_pos") - 1) / F.lit(s.chunk_rows)))

    def point(c: str) -> Column:
        known = F.struct("_pos", F.col(at).alias("at"), F.col(c).alias("x"))
        return F.when(F.col(c).isNotNull(), known)

    ends = blocked.groupBy(*s.key, "_blk").agg(
        *[F.max(point(c)).alias(f"_last_{c}") for c in columns],
        *[F.min(point(c)).alias(f"_first_{c}") for c in columns],
    )
    blocks = Window.partitionBy(*s.key).orderBy("_blk")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        *s.key,
        "_blk",
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(later).alias(f"_out_{c}") for c in columns],
    )
    row = Window.partitionBy(*s.key, "_blk").orderBy("_pos")
    back = row.rowsBetween(Window.unboundedPreceding, 0)
    ahead = row.rowsBetween(0, Window.unboundedFollowing)
    return blocked.join(carried, [*s.key, "_blk"]).select(
        *df.columns,
        *[
            F.coalesce(F.last(point(c), ignorenulls=True).over(back), F.col(f"_in_{c}")).alias(f"_before_{c}")
            for c in columns
        ],
        *[
            F.coalesce(F.first(point(c), ignorenulls=True).over(ahead), F.col(f"_out_{c}")).alias(f"_after_{c}")
            for c in columns
        ],
    )
