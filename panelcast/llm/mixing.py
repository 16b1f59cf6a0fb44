"""Mixing sources to target weights by repeating documents.

Words are summed per source, each source's repetition rate follows from its target, and a document is
emitted floor(rate) times plus once more with the probability of the rate's fraction, decided by a
hash of the seed and its id. Each source takes, of a few shifts of these hashes, the one whose draws
bring its words nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import word_count
from panelcast.session import cut_lineage

MOST_REPEATS = 3
SHIFTS = 32


def unit_hash(*parts: Column) -> Column:
    """A number from 0 to 1, evenly spread, from the MD5 digest of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target and rate, from documents' ``source`` and ``size``.

    Sources weigh 1, 2, 3, 1, ... in the order of code points, null last. The targets share all words
    by weight; a target above ``most`` times its source stops there, and its excess is shared again
    among the others by weight. In the order of the level at which a source reaches its limit, the
    ones that stop are a prefix, so running sums give the result without repeated rounds. There is
    one row per source.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    rows = rows.withColumn("limit", F.col("source_size") * most).withColumn("level", F.col("limit") / F.col("weight"))
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(ahead), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))).alias("weights"),
    )
    # a source stops if, those before it stopped, its share of what is left is at its limit or above
    rows = rows.withColumn("stops", F.col("left") * F.col("weight") >= F.col("limit") * F.col("weights"))
    free = F.first(F.when(~F.col("stops"), F.struct("left", "weights")), ignorenulls=True).over(whole)
    rows = rows.withColumn("free", free)
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("free.left").cast("double") * F.col("weight") / F.col("free.weights"))
    rows = rows.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def _plan(sizes: DataFrame, seed: int) -> DataFrame:
    """_source, _source_size, _target, _rate and _shift of every source of ``sizes`` (id, source, size)."""
    plan = _with_shift(sizes, cut_lineage(source_targets(sizes)), seed)
    return plan.select(*[F.col(c).alias(f"_{c}") for c in ("source", "source_size", "target", "rate", "shift")])


def _copies(seed: int, id_col: str) -> Column:
    """How often a row joined with its source's plan is taken."""
    extra = _drawn(unit_hash(F.lit(seed), F.col(id_col)), F.col("_shift"), F.col("_rate"))
    return F.floor("_rate").cast("long") + extra.cast("long")


def _drawn(unit: Column, shift: Column, rate: Column) -> Column:
    """Whether a document's hash, shifted around the unit circle, draws the fractional copy."""
    moved = unit + shift / F.lit(float(SHIFTS))
    return moved - F.floor(moved) < rate - F.floor(rate)


def _with_shift(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``targets`` with the shift, from 0 to SHIFTS - 1, that brings each source nearest to its target."""
    rates = targets.select(F.col("source").alias("of"), "rate")
    rows = sizes.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("unit", unit_hash(F.lit(seed), F.col("id")))
    taken = [F.sum(F.when(_drawn(F.col("unit"), F.lit(i), F.col("rate")), F.col("size")).otherwise(0)).alias(f"t{i}") for i in range(SHIFTS)]
    sums = rows.groupBy("of").agg(*taken)
    joined = targets.join(sums, F.col("source").eqNullSafe(F.col("of")))
    goal = F.col("target") - F.floor("rate") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - goal).alias("off"), F.lit(i).alias("shift")) for i in range(SHIFTS)]))
    return cut_lineage(joined.select("source", "source_size", "target", "rate", best["shift"].alias("shift")))


def mix_report(docs: DataFrame, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs``; see :func:`mix`."""
    sizes = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))
    rows = sizes.join(_plan(sizes, seed), F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * _copies(seed, "id")
    return rows.select(F.col("id").alias("doc_id"), "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"))


def mix(docs: DataFrame, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    A document's size is its number of words. Null texts and texts without words have size 0, a
    source without words has the target 0 and gives none of its documents. A null source is a source
    of its own. Rows with the same id are decided alike, so that reruns agree; null ids count as one.
    Empty input gives an empty result. Other columns may have any name: all are renamed meanwhile.
    """
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{names.index(n)}" for n in (id_col, text_col, source_col)}
    sizes = safe.select(F.col(at[id_col]).alias("id"), F.col(at[source_col]).alias("source"), word_count(F.col(at[text_col])).alias("size"))
    rows = safe.join(_plan(cut_lineage(sizes), seed), F.col(at[source_col]).eqNullSafe(F.col("_source"))).withColumn("_copies", _copies(seed, at[id_col]))
    repeated = rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
