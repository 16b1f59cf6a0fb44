"""Quantile gradient boosting over all series, many boosters at a time.

Features are cut into bins once and the table of bins is written. Boosters that differ in quantile
level, training cutoff or settings are grown together on it: a pass over the rows serves one level of
the current tree of all of them. The gradient of the pinball loss takes two values, so a pass only
counts rows, and rows above their prediction, per (booster, node, feature, bin). Counts are whole
numbers: splits do not depend on how rows are spread over tasks. A leaf's value is the quantile of its
rows' residuals, from Spark's mergeable sketch, exact for leaves of up to ``ACCURACY`` rows.

What reaches the driver is bounded by boosters, nodes, features and bins, never by rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.groups import top_per_group
from panelcast.session import cut_lineage

BINS = 32
ACCURACY = 10_000
# rounds between two writings of the boosters' predictions
REFRESH = 8


@dataclass(frozen=True)
class Booster:
    """One of the boosters grown together. Only rows up to day ``until`` (days since 1970) are learned;
    ``columns`` are the positions of the features it may use."""

    name: str
    level: float = 0.5
    until: int | None = None
    rounds: int = 20
    depth: int = 3
    rate: float = 0.3
    least: int = 20
    columns: tuple[int, ...] | None = None


@dataclass
class Tree:
    """Nodes in heap order (children of i at 2i+1 and 2i+2). A row goes left where its bin is at most
    ``cut``; bin 0 holds missing values. ``feature`` is -1 where a node is not split."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size), np.zeros(size), np.zeros(size, dtype=int))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        every = np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            right = bins[every, np.maximum(f, 0)] > self.cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Ensemble:
    booster: Booster
    trees: list[Tree] = field(default_factory=list)

    def predict(self, bins: np.ndarray, last: int | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees if last is None else self.trees[len(self.trees) - last:]:
            out += tree.value[tree.leaf(bins)]
        return out


@dataclass
class Model:
    """Fitted boosters with the features and cuts they share."""

    features: list[str]
    cuts: list[np.ndarray]
    ensembles: list[Ensemble]


def feature_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct approximate quantiles of every feature, one job for all of them."""
    levels = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    known = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in features]
    row = df.agg(*[F.percentile_approx(c, levels, ACCURACY).alias(f"q{i}") for i, c in enumerate(known)]).first()
    return [np.unique(np.array(v if v is not None else [], dtype=float)) for v in row]


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``_bins``: one byte per feature, 0 for null and NaN, else one more than the
    number of cuts below the value."""
    values = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    rows = df.select(*keep, *values)
    kept = [f for f in rows.schema.fields if f.name in keep]
    schema = T.StructType([*kept, T.StructField("_bins", T.BinaryType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, len(cuts)), dtype=np.uint8)
            for i, c in enumerate(cuts):
                x = batch.column(n + i).to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(c, x, side="left"))
            data = pa.py_buffer(out.tobytes())
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(cuts))
            bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends.buffers()[1], data])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], bins], names=schema.names)

    return rows.mapInArrow(run, schema)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix."""
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=kind)


def _predictions(batch: pa.RecordBatch, ensembles: list[Ensemble], pending: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins, and predictions per booster: those written with the rows and the ``pending`` last trees."""
    bins = _matrix(batch.column(0), np.uint8)
    base = batch.column(3)
    told = np.zeros((len(bins), len(ensembles))) if base.null_count else _matrix(base, np.float64).copy()
    for k, e in enumerate(ensembles):
        told[:, k] += e.predict(bins, pending)
    return bins, told


def _learned(booster: Booster, day: np.ndarray) -> np.ndarray:
    return np.ones(len(day), dtype=bool) if booster.until is None else day <= booster.until


def _count_cells(state: DataFrame, ensembles: list[Ensemble], growing: dict[int, Tree], pending: int, level: int, width: int):
    """Rows and rows above their prediction per (booster, node, feature and bin), summed over tasks."""
    first, nodes = 2**level - 1, 2**level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            bins, told = _predictions(batch, ensembles, pending)
            y, day = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cells = np.arange(bins.shape[1]) * width + bins
            size = nodes * bins.shape[1] * width
            for k, tree in growing.items():
                at = tree.leaf(bins) - first
                use = (at >= 0) & _learned(ensembles[k].booster, day)
                where = at[use, None] * (bins.shape[1] * width) + cells[use]
                above = (y > told[:, k])[use]
                both = np.stack([np.bincount(where.ravel(), minlength=size), np.bincount(where[above].ravel(), minlength=size)])
                sums[k] = sums.get(k, 0) + both
        for k, both in sums.items():
            at = np.flatnonzero(both[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(both[0][at]), pa.array(both[1][at])], names=["k", "cell", "n", "above"])

    return state.mapInArrow(run, "k long, cell long, n long, above long").groupBy("k", "cell").agg(F.sum("n").alias("n"), F.sum("above").alias("above")).toArrow()


def best_split(n: np.ndarray, above: np.ndarray, booster: Booster) -> tuple[int, int, float] | None:
    """Feature, last bin of the left side, and gain of the best split of a node, from its counts per
    (feature, bin). The gain is how much the squared sums of gradients over counts rise."""
    g = above - n * (1 - booster.level)
    left_n, left_g = np.cumsum(n, axis=1)[:, :-1], np.cumsum(g, axis=1)[:, :-1]
    all_n, all_g = n.sum(axis=1, keepdims=True), g.sum(axis=1, keepdims=True)
    right_n, right_g = all_n - left_n, all_g - left_g
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_g**2 / left_n + right_g**2 / right_n - all_g**2 / all_n
    gain[(left_n < booster.least) | (right_n < booster.least)] = 0
    if booster.columns is not None:
        gain[[f for f in range(len(gain)) if f not in booster.columns]] = 0
    # sums of the same numbers in another order differ in the last bits: ties go to the first feature and bin
    at = int(np.argmax(np.round(gain, 9)))
    f, b = divmod(at, gain.shape[1])
    return (f, b, float(gain[f, b])) if gain[f, b] > 1e-9 else None


def _leaf_values(state: DataFrame, ensembles: list[Ensemble], growing: dict[int, Tree], pending: int) -> dict[tuple[int, int], tuple[list, int]]:
    levels = sorted({e.booster.level for e in ensembles})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, told = _predictions(batch, ensembles, pending)
            y, day = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k, tree in growing.items():
                use = _learned(ensembles[k].booster, day)
                leaf = tree.leaf(bins)[use]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), k)), pa.array(leaf), pa.array((y - told[:, k])[use])], names=["k", "leaf", "r"])

    rows = state.mapInArrow(run, "k long, leaf long, r double").groupBy("k", "leaf")
    found = rows.agg(F.percentile_approx("r", F.array(*map(F.lit, levels)), ACCURACY).alias("v"), F.count("*").alias("n")).collect()
    return {(r["k"], r["leaf"]): (r["v"][levels.index(ensembles[r["k"]].booster.level)], r["n"]) for r in found}


def grow(table: DataFrame, boosters: list[Booster], features: int, width: int = BINS + 1, refresh: int = REFRESH) -> list[Ensemble]:
    """Boosters grown together on ``table`` (_bins, _y, _day) of so many features with bins below ``width``;
    rows without ``_y`` teach nothing. The first tree of each is its one quantile of all its rows."""
    ensembles = [Ensemble(b) for b in boosters]
    state = table.where("_y is not null").select("_bins", F.col("_y").cast("double").alias("_y"), F.col("_day").cast("int").alias("_day"), F.lit(None).cast("binary").alias("_told"))
    pending, rounds = 0, max(b.rounds for b in boosters)
    for r in range(rounds + 1):
        growing = {k: Tree.empty(b.depth if r else 0) for k, b in enumerate(boosters) if r <= b.rounds}
        for level in range(max(b.depth for b in boosters) if r else 0):
            parents = slice(2 ** (level - 1) - 1, 2**level - 1) if level else None
            wanted = {k: t for k, t in growing.items() if level < boosters[k].depth and (parents is None or (t.feature[parents] >= 0).any())}
            if not wanted:
                break
            counts = _count_cells(state, ensembles, wanted, pending, level, width)
            _split_level(counts, wanted, boosters, level, features, width)
        for (k, leaf), (value, n) in _leaf_values(state, ensembles, growing, pending).items():
            growing[k].value[leaf] = value * (boosters[k].rate if r else 1.0)
            growing[k].rows[leaf] = n
        # boosters that have ended keep step, so that the last trees of all are those not yet written
        for k, e in enumerate(ensembles):
            e.trees.append(growing.get(k, Tree.empty(0)))
        pending += 1
        if pending == refresh and r < rounds:
            state, pending = cut_lineage(_told(state, ensembles, pending)), 0
    for e in ensembles:
        e.trees = e.trees[:e.booster.rounds + 1]
    return ensembles


def _split_level(counts: pa.Table, growing: dict[int, Tree], boosters: list[Booster], level: int, features: int, width: int) -> None:
    """Set the splits of one level of the growing trees from the counts of their cells."""
    k, cell, n, above = (counts.column(c).to_numpy() for c in ("k", "cell", "n", "above"))
    for booster, tree in growing.items():
        mine = k == booster
        full = np.zeros((2, 2**level * features * width), dtype=np.int64)
        full[0, cell[mine]], full[1, cell[mine]] = n[mine], above[mine]
        for node, (rows, over) in enumerate(full.reshape(2, 2**level, features, width).swapaxes(0, 1)):
            split = best_split(rows, over, boosters[booster]) if rows.any() else None
            if split is not None:
                at = 2**level - 1 + node
                tree.feature[at], tree.cut[at], tree.gain[at] = split
                tree.rows[at] = rows[0].sum()


def _told(state: DataFrame, ensembles: list[Ensemble], pending: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, told = _predictions(batch, ensembles, pending)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([row.tobytes() for row in told], pa.binary())], names=["_bins", "_y", "_day", "_told"])

    return state.mapInArrow(run, state.schema)


def fit(df: DataFrame, features: list[str], target: str, boosters: list[Booster], time: str | None = None, bins: int = BINS, cuts_until: int | None = None) -> Model:
    """Bin ``df`` and grow ``boosters`` on it. ``time`` is the date that ``until`` refers to; cuts are those of
    rows up to ``cuts_until``, so that later rows change nothing for boosters that must not know them."""
    day = F.lit(0) if time is None else F.unix_date(F.col(time).cast("date"))
    rows = df.withColumns({"_y": F.col(target).cast("double"), "_day": day}).where("_y is not null and not isnan(_y)")
    cuts = feature_cuts(rows if cuts_until is None else rows.where(F.col("_day") <= cuts_until), features, bins)
    table = cut_lineage(binned(rows, features, cuts, ["_y", "_day"]))
    return Model(features, cuts, grow(table, boosters, len(features), bins + 1))


def predict(df: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``_pred``, one value per booster."""
    rows = binned(df, model.features, model.cuts, keep)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_pred", T.ArrayType(T.DoubleType()))])
    ensembles = model.ensembles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch.column(batch.num_columns - 1), np.uint8)
            told = np.column_stack([e.predict(bins) for e in ensembles])
            ends = pa.array(np.arange(len(told) + 1, dtype=np.int32) * len(ensembles))
            pred = pa.ListArray.from_arrays(ends, pa.array(told.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pred], names=schema.names)

    return rows.mapInArrow(run, schema)


# ---- fitted trees as rows and as expressions ----------------------------------------------

NODES = "booster string, level double, tree int, node int, feature string, cut double, value double, gain double, n long"


def nodes(spark, model: Model) -> DataFrame:
    """A model as a table, one row per node that rows reach. Rows go left where the feature is at most
    ``cut`` or missing; the feature of a leaf is null."""
    out = []
    for e in model.ensembles:
        for t, tree in enumerate(e.trees):
            for i in np.flatnonzero(tree.rows):
                f = int(tree.feature[i])
                name, cut = (None, None) if f < 0 else (model.features[f], _cut(model, f, int(tree.cut[i])))
                out.append((e.booster.name, e.booster.level, t, int(i), name, cut, float(tree.value[i]), float(tree.gain[i]), int(tree.rows[i])))
    return spark.createDataFrame(out, NODES)


def _cut(model: Model, feature: int, bin_: int) -> float:
    return float(model.cuts[feature][min(bin_, len(model.cuts[feature])) - 1]) if bin_ else -math.inf


def expression(model: Model, ensemble: Ensemble, x: Column) -> Column:
    """The prediction from the array ``x`` of feature values, as an expression that walks the trees' node
    arrays in the JVM."""
    size = max(len(t.feature) for t in ensemble.trees)
    depth = int(math.log2(size + 1)) - 1
    feature, cut, value = [], [], []
    for t in ensemble.trees:
        rest = size - len(t.feature)
        feature += [int(f) for f in t.feature] + [-1] * rest
        cut += [_cut(model, f, int(b)) if f >= 0 else 0.0 for f, b in zip(t.feature, t.cut)] + [0.0] * rest
        value += [float(v) for v in t.value] + [0.0] * rest
    features, cuts, values = F.lit(feature), F.lit(cut), F.lit(value)

    def down(at: Column, first: Column) -> Column:
        f = F.get(features, first + at)
        left = F.coalesce(F.nanvl(F.get(x, f), F.lit(-math.inf)), F.lit(-math.inf)) <= F.get(cuts, first + at)
        return F.when(f < 0, at).otherwise(2 * at + F.when(left, 1).otherwise(2))

    def one(total: Column, tree: Column) -> Column:
        first = tree * F.lit(size)
        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), lambda at, _: down(at, first)) if depth else F.lit(0)
        return total + F.get(values, first + leaf)

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(ensemble.trees) - 1)), F.lit(0.0), one)


def gain_importances(table: DataFrame) -> DataFrame:
    """Share of each feature in the split gains of a booster, averaged over boosters, from ``nodes``."""
    split = table.where("feature is not null")
    share = F.sum("gain") / F.sum(F.sum("gain")).over(Window.partitionBy("booster"))
    per = split.groupBy("booster", "feature").agg(share.alias("importance"))
    count = split.agg(F.countDistinct("booster").alias("_boosters"))
    return per.groupBy("feature").agg(F.sum("importance").alias("importance")).join(F.broadcast(count)).select("feature", (F.col("importance") / F.col("_boosters")).alias("importance"))


def permutation_importances(df: DataFrame, model: Model, target: str, seed: int = 7) -> DataFrame:
    """By how much the mean pinball loss of a feature's boosters rises when its values change places.

    One pass: values are permuted within the batches that Spark hands to a task, every feature in turn, so
    rows never move. Rows without target are left out.
    """
    rows = binned(df.where(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double")), model.features, model.cuts, ["_y"])
    names, ensembles = model.features, model.ensembles

    def loss(y: np.ndarray, bins: np.ndarray) -> float:
        out = 0.0
        for e in ensembles:
            miss = y - e.predict(bins)
            out += np.maximum(e.booster.level * miss, (e.booster.level - 1) * miss).sum()
        return out / len(ensembles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        for batch in batches:
            y, bins = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint8)
            base, risen = loss(y, bins), []
            for f in range(len(names)):
                moved = bins.copy()
                moved[:, f] = bins[rng.permutation(len(bins)), f]
                risen.append(loss(y, moved) - base)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(risen), pa.array([len(y)] * len(names))], names=["feature", "risen", "n"])

    sums = rows.mapInArrow(run, "feature string, risen double, n long").groupBy("feature")
    return sums.agg((F.sum("risen") / F.sum("n")).alias("importance"))


# ---- forecasts that feed on themselves ------------------------------------------------------


def recursive(history: DataFrame, key: list[str], time: str, target: str, depth: int, n_weeks: int, value: Callable[[Column, Column], Column]) -> DataFrame:
    """Forecasts of ``n_weeks`` after each series' last row: ``value(past, date)`` gives a step from the array of
    the values before it (real ones, then predictions), oldest first, and its date. All steps are one fold
    inside a row. A series of fewer than ``depth`` known rows gets its dates with NULL."""
    known = history.where(F.col(target).isNotNull()).select(*key, F.col(time).alias("_t"), F.col(target).cast("double").alias("_v"))
    recent = top_per_group(known, key, [F.col("_t").desc()], depth)
    series = recent.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_t", "_v"))).alias("_p"), F.max("_t").alias("_last"))

    def step(past: Column, i: Column) -> Column:
        return F.concat(past, F.array(value(past, F.date_add("_last", (i * 7).cast("int")))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(n_weeks)), F.transform("_p", lambda p: p["_v"]), step)
    ahead = F.when(F.size("_p") == depth, F.slice(path, depth + 1, n_weeks)).otherwise(F.array_repeat(F.lit(None).cast("double"), n_weeks))
    return series.select(*key, "_last", F.posexplode(ahead).alias("_i", "median")).select(
        *key, (F.col("_i") + 1).alias("step"), F.date_add("_last", ((F.col("_i") + 1) * 7).cast("int")).alias(time), "median"
    )
