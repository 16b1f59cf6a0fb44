"""Cubic spline imputation, in blocks of knots.

The bends (second derivatives) of a natural cubic spline solve a tridiagonal system over all knots of a
series. It is cut into blocks of ``knots`` consecutive knots, in different tasks: each block writes its
bends as a sum of its own part and a multiple of each neighbour's nearest bend; one row per block goes
into a small chain that gives these bends, and the blocks put them in. The result is the spline of the
whole series, however its knots are spaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import finite
from panelcast.series import Series, positions
from panelcast.session import cut_lineage

KNOTS = 1_024


def make_bends():
    # nested, so that it travels to the executors with the UDF that uses it
    def bends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Second derivatives, at the points, of the natural cubic spline through them."""
        n = len(x)
        if n < 3:
            return np.zeros(n)
        h = np.diff(x)
        a = np.zeros((n, n))
        b = np.zeros(n)
        a[0, 0] = a[-1, -1] = 1.0
        inner = np.arange(1, n - 1)
        a[inner, inner - 1], a[inner, inner], a[inner, inner + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
        b[1:-1] = 6 * np.diff(np.diff(y) / h)
        return np.linalg.solve(a, b)

    return bends


def make_natural_spline():
    """Value at ``at`` of the natural cubic spline through points, or of the line through two."""
    bends = make_bends()

    def natural_spline(x: np.ndarray, y: np.ndarray, at: float) -> float:
        if len(x) == 0:
            return np.nan
        if len(x) < 3:
            return float(np.interp(at, x, y))
        m = bends(x, y)
        i = int(np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2))
        return float(_piece([x[i], x[i + 1], y[i], y[i + 1], m[i], m[i + 1]], at))

    return natural_spline


def make_block_bends():
    # nested, so that it travels to the executors with the UDFs that use it
    def block_bends(x: np.ndarray, y: np.ndarray, first: int, count: int, at: int, n: int) -> np.ndarray:
        """Rows ``own, left, right`` of ``count`` knots: a bend is own + left * bend before + right * bend behind.

        ``x`` and ``y`` have one more knot on either side where the series has one; the block begins at
        ``first`` in them, which is knot ``at`` (from 0) of ``n`` in the series.
        """
        part, upper, before = np.zeros((count, 3)), np.zeros(count), 0.0
        for i in range(count):
            k = first + i
            if at + i in (0, n - 1):
                continue  # the ends do not bend
            h0, h1 = x[k] - x[k - 1], x[k + 1] - x[k]
            right = 6 * ((y[k + 1] - y[k]) / h1 - (y[k] - y[k - 1]) / h0)
            low = h0 if i else 0.0
            pivot = 2 * (h0 + h1) - low * before
            row = np.array([right, -h0 if i == 0 else 0.0, -h1 if i == count - 1 else 0.0])
            part[i] = (row - low * part[i - 1]) / pivot if i else row / pivot
            before = upper[i] = h1 / pivot if i < count - 1 else 0.0
        for i in range(count - 2, -1, -1):
            part[i] -= upper[i] * part[i + 1]
        return part

    return block_bends


def make_chain():
    def chain(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bends before and behind each block, from the rows of its first and its last knot."""
        n = len(first)
        to_first, to_last = np.zeros((n, 2)), np.zeros((n, 2))  # constant, multiple of the next block's first bend
        a = c = 0.0
        for i in range(n):
            (u, v, w), (p, q, r) = first[i], last[i]
            to_first[i] = (u + v * a) / (1 - v * c), w / (1 - v * c)
            a, c = p + q * (a + c * to_first[i, 0]), r + q * c * to_first[i, 1]
            to_last[i] = a, c
        before, behind, after = np.zeros(n), np.zeros(n), 0.0
        for i in range(n - 1, -1, -1):
            behind[i] = after
            if i + 1 < n:
                before[i + 1] = to_last[i, 0] + to_last[i, 1] * after
            after = to_first[i, 0] + to_first[i, 1] * after
        return before, behind

    return chain


def _gap_pieces(known: DataFrame, s: Series, knots: int) -> DataFrame:
    """``_p`` per gap between known points ``_at``, ``_x``: position, value and bend at its two ends."""
    keys = list(s.key)
    at = F.col("_pos") - 1
    block, place = F.floor(at / knots), at % knots
    near = F.array(
        block, F.when((place == 0) & (block > 0), block - 1), F.when((place == knots - 1) & (at < F.col("_n") - 1), block + 1)
    )
    # written: both passes over the blocks read it
    rows = cut_lineage(
        positions(known, s).select(*keys, "_at", "_x", "_n", at.alias("_i"), F.explode(F.array_compact(near)).alias("_b"))
    )
    key_fields = [T.StructField(k, known.schema[k].dataType) for k in keys]
    block_bends, chain = make_block_bends(), make_chain()

    def bends(table: pa.Table):
        table = table.sort_by("_i")
        b, index = table.column("_b")[0].as_py(), table.column("_i").to_numpy()
        x, y = table.column("_at").to_numpy().astype(float), table.column("_x").to_numpy()
        own = np.flatnonzero(index // knots == b)
        return x, y, own, block_bends(x, y, own[0], len(own), index[own[0]], table.column("_n")[0].as_py())

    def made(table: pa.Table, names: list[str], rows: int, **columns) -> pa.Table:
        """``columns`` beside the group's ``names``, repeated."""
        fixed = {k: pa.array([table.column(k)[0].as_py()] * rows, table.schema.field(k).type) for k in names}
        return pa.table({**fixed, **columns})

    def reduce(table: pa.Table) -> pa.Table:
        part = bends(table)[3]
        first, last = (pa.array([part[i].tolist()], pa.list_(pa.float64())) for i in (0, -1))
        return made(table, [*keys, "_b"], 1, _first=first, _last=last)

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("_b")
        before, behind = chain(*[np.array(table.column(c).to_pylist()) for c in ("_first", "_last")])
        return made(table, keys, len(before), _b=table.column("_b"), _before=pa.array(before), _behind=pa.array(behind))

    def pieces(table: pa.Table) -> pa.Table:
        before, behind = table.column("_before")[0].as_py(), table.column("_behind")[0].as_py()
        x, y, own, part = bends(table)
        m = np.append(part @ [1.0, before, behind], behind)
        gaps = [[x[k], x[k + 1], y[k], y[k + 1], m[i], m[i + 1]] for i, k in enumerate(own) if k + 1 < len(x) and x[k + 1] - x[k] > 1]
        return made(table, keys, len(gaps), _p=pa.array(gaps, pa.list_(pa.float64())))

    number, numbers = T.DoubleType(), T.ArrayType(T.DoubleType())
    block_field = T.StructField("_b", T.LongType())
    ends = rows.groupBy(*keys, "_b").applyInArrow(
        reduce, T.StructType([*key_fields, block_field, T.StructField("_first", numbers), T.StructField("_last", numbers)])
    )
    joined = ends.groupBy(*keys).applyInArrow(
        join, T.StructType([*key_fields, block_field, T.StructField("_before", number), T.StructField("_behind", number)])
    )
    return rows.join(joined, [*keys, "_b"]).groupBy(*keys, "_b").applyInArrow(
        pieces, T.StructType([*key_fields, T.StructField("_p", numbers)])
    )


def _piece(p, at):
    """Value at ``at`` of the cubic between the ends in ``p``; columns or numbers."""
    x0, x1, y0, y1, m0, m1 = (p[i] for i in range(6))
    h, left, right = x1 - x0, x1 - at, at - x0
    return (m0 * left * left * left + m1 * right * right * right) / (6 * h) + (y0 / h - m0 * h / 6) * left + (y1 / h - m1 * h / 6) * right


def spline_columns(df: DataFrame, columns: list[str], s: Series = Series(), knots: int = KNOTS) -> DataFrame:
    """Fill inner gaps of each column by the natural cubic spline; gaps at either end stay NULL.

    NaN and infinities are filled too: one of them would spoil the spline of its whole series. A task holds ``knots`` known points; one row per that many goes through one task of a series.
    """
    for c in columns:
        placed = positions(df, s).withColumn(c, finite(F.col(c).cast("double")))
        known = placed.where(F.col(c).isNotNull()).select(*s.key, s.time, F.col("_pos").alias("_at"), F.col(c).alias("_x"))
        # one solution per gap, then one row per missing position in it
        fills = _gap_pieces(known, s, knots).select(
            *s.key, "_p", F.explode(F.sequence(F.element_at("_p", 1).cast("long") + 1, F.element_at("_p", 2).cast("long") - 1)).alias("_pos")
        ).withColumn("_fill", _piece(F.col("_p"), F.col("_pos").cast("double")))
        # each column reads the panel several times: write the outcome before the next
        df = cut_lineage(
            placed.join(fills.select(*s.key, "_pos", "_fill"), [*s.key, "_pos"], "left")
            .withColumn(c, F.coalesce(c, "_fill"))
            .select(*df.columns)
        )
    return df
