"""Embedding near-duplicates through an inverted multi-index.

Unit vectors are cut in two halves, each half has a codebook of its own, and the product of the two
codebooks is a grid of cells. Every vector lies in the cell of its nearest centroids. Its search visits
cells in the order of a lower bound of their distance, sequences of both halves merged, and stops where
the bound passes the radius that the wanted cosine allows; the bound is exact, so the recall is 1. A
pair is looked for from the side with the smaller cell only, and in a common cell once. Pairs found are
verified in double precision.

Vectors of each width have codebooks and cells of their own; a width of few vectors is one cell.

Equal vectors of a label are one class. Visits and cell contents meet in blocks of bounded size, and a
block gives out counts and one link per vector and local component instead of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.components import connected_components
from panelcast.session import cut_lineage

SAMPLE = 20_000
CELL_ROWS = 1_000
BLOCK_ROWS = 2_048
MOST_CENTROIDS = 1_024


def _keyed(rows: DataFrame) -> DataFrame:
    """Add ``key``, a digest of the vector; null without a label or if the vector is null, zero or not finite."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    digest = F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: x.cast("string"))).cast("binary"), 256)
    return rows.withColumn("key", F.when(usable, digest))


def fit_codebooks(sample: np.ndarray, centroids: int, rounds: int = 12, seed: int = 7) -> list[np.ndarray]:
    """A codebook for each half of the unit vectors in ``sample``, by Lloyd's rounds."""
    half = sample.shape[1] // 2
    books = []
    for part in (sample[:, :half], sample[:, half:]):
        distinct = np.unique(part, axis=0)
        pick = np.random.default_rng(seed).permutation(len(distinct))[:centroids]
        book = distinct[pick].copy()
        for _ in range(rounds):
            nearest = np.argmin((book**2).sum(axis=1) - 2 * part @ book.T, axis=1)
            count = np.bincount(nearest, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, nearest, part)
            book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
        books.append(book)
    return books


def _apart(book: np.ndarray) -> np.ndarray:
    """Distances between centroids, never below the true ones, since a bound divides by them."""
    square = (book**2).sum(axis=1)
    return np.sqrt(np.maximum(square[:, None] + square - 2 * book @ book.T, 0) + 1e-12)


def _bounds(part: np.ndarray, book: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each half vector, and a lower bound of its distance to anything in each cell.

    What lies nearest to centroid j is on its side of the plane halfway to any other centroid i; a
    vector on the other side is at least as far away as the plane.
    """
    square = np.maximum((part**2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * part @ book.T, 0)
    nearest = np.argmin(square, axis=1)
    own = square[np.arange(len(part)), nearest]
    return nearest, np.maximum(square - own[:, None], 0) / (2 * apart[nearest])


def _unit(lists: pa.Array, width: int) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of large or tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def multi_sequence(low: np.ndarray, high: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Pairs of cells of the two halves in the order of the sum of their bounds, up to ``limit``."""
    a, b = np.argsort(low, kind="stable"), np.argsort(high, kind="stable")
    a, b = a[low[a] <= limit], b[high[b] <= limit]
    total = low[a][:, None] + high[b][None, :]
    i, j = np.nonzero(total <= limit)
    order = np.argsort(total[i, j], kind="stable")
    return list(zip(a[i[order]].tolist(), b[j[order]].tolist()))


def _visits(classes: DataFrame, books: dict[int, list[np.ndarray]], radius: float) -> DataFrame:
    """A row per vector in its own cell (home) and per other cell that its search visits.

    ``books`` has the two codebooks of a width; a width without them is one cell.
    """
    shared = classes.sparkSession.sparkContext.broadcast({w: [(b, _apart(b)) for b in pair] for w, pair in books.items()})
    # rounding must not lose a vector on the edge of a cell
    limit = (radius + 1e-9) ** 2

    def placed(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
        n = batch.num_rows
        row, cell = list(range(n)), [0] * n
        if width in shared.value:
            (a, apart_a), (b, apart_b) = shared.value[width]
            x, half = _unit(batch.column("embedding"), width), width // 2
            (na, low), (nb, high) = _bounds(x[:, :half], a, apart_a), _bounds(x[:, half:], b, apart_b)
            row, cell = [], []
            for i in range(n):
                own = int(na[i]) * len(b) + int(nb[i])
                # the pair of two cells is searched from the one with the larger number
                cells = [c for c in (p * len(b) + q for p, q in multi_sequence(low[i] ** 2, high[i] ** 2, limit)) if c < own]
                row += [i] * (len(cells) + 1)
                cell += [own, *cells]
        row, cell = np.array(row), np.array(cell, dtype=np.int32)
        home = np.r_[True, row[1:] != row[:-1]]
        taken = batch.take(pa.array(row))
        return pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell), pa.array(home)], names=[*batch.schema.names, "cell", "home"])

    def run(batches):
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                yield placed(batch.filter(pa.array(widths == width)), int(width))

    kind = classes.schema["embedding"].dataType.simpleString()
    label = classes.schema["label"].dataType.simpleString()
    return classes.select("node", "label", "width", "embedding", "copies").mapInArrow(
        run, f"node long, label {label}, width int, embedding {kind}, copies long, cell int, home boolean"
    )


def _links(visits: DataFrame, cosine: float, block: int) -> DataFrame:
    """Per node and block: rows linked with it there, and a node of its local component.

    The contents and the visits of a cell are each cut into blocks of about ``block`` rows by a hash,
    and every block of contents meets every block of contents and of visits once.
    """
    load = visits.groupBy("label", "width", "cell").agg(F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("h"), F.ceil(F.sum((~F.col("home")).cast("int")) / block).cast("int").alias("v"))
    rows = visits.join(cut_lineage(load.where("h > 0")), ["label", "width", "cell"])
    at = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("h")).otherwise(F.col("v"))).cast("int")
    rows = rows.withColumn("at", at)
    # side 0 are contents, side 1 what is compared with them: later contents, or visits (numbered from h on)
    as_content = rows.where("home").withColumn("to", F.explode(F.sequence(F.col("at"), F.col("h") + F.col("v") - 1))).select(
        "label", "width", "cell", F.col("at").alias("i"), F.col("to").alias("j"), F.lit(0).alias("side"), "node", "embedding", "copies"
    )
    own = rows.where("home and at > 0").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("at") - 1))).withColumn("j", F.col("at"))
    other = rows.where("not home").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("j", F.col("h") + F.col("at"))
    compared = own.unionByName(other).select("label", "width", "cell", F.col("to").alias("i"), "j", F.lit(1).alias("side"), "node", "embedding", "copies")

    def run(table: pa.Table) -> pa.Table:
        side, node, copies = (table.column(c).to_numpy() for c in ("side", "node", "copies"))
        x = _unit(table.column("embedding").combine_chunks(), table.column("width")[0].as_py())
        order = np.lexsort((node, side))
        side, node, copies, x = side[order], node[order], copies[order], x[order]
        n = int((side == 0).sum())
        inner = table.column("i")[0] == table.column("j")[0]  # a block of contents with itself
        left, right = x[:n], x if inner else x[n:]
        near = left @ right.T >= cosine - 1e-9
        i, j = np.nonzero(near)
        j = j if inner else j + n
        if inner:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[exact], j[exact]
        count = np.bincount(i, weights=copies[j], minlength=len(node)) + np.bincount(j, weights=copies[i], minlength=len(node))
        part = np.arange(len(node))
        while True:  # smallest position of the local component
            low = part.copy()
            np.minimum.at(low, i, part[j])
            np.minimum.at(low, j, part[i])
            low = low[low]
            if (low == part).all():
                break
            part = low
        use = np.flatnonzero(count > 0)
        return pa.table({"node": pa.array(node[use], pa.int64()), "linked": pa.array(count[use].astype(np.int64)), "with": pa.array(node[part[use]], pa.int64())})

    return as_content.union(compared).groupBy("label", "width", "cell", "i", "j").applyInArrow(run, "node long, linked long, with long")


def _codebooks(classes: DataFrame, sample: int, cell_rows: int) -> dict[int, list[np.ndarray]]:
    """Codebooks of each width of which some label has more than ``cell_rows`` classes.

    The widths share the ``sample`` vectors evenly. Cells of other widths would not fill, so those need none.
    """
    per_label = classes.groupBy("label", "width").agg(F.count("*").alias("n"))
    large = per_label.groupBy("width").agg(F.sum("n").alias("total"), F.max("n").alias("most")).where((F.col("most") > cell_rows) & (F.col("width") > 1)).collect()
    if not large:
        return {}
    share = sample / len(large)
    bound = F.create_map(*[F.lit(v) for r in large for v in (r["width"], int((1 << 30) * min(1.0, share / r["total"])))])
    drawn = classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < bound[F.col("width")])
    table = drawn.select("width", "embedding").toArrow().combine_chunks()
    books, widths = {}, table.column("width").to_numpy()
    for r in large:
        found = table.filter(pa.array(widths == r["width"])).column("embedding").combine_chunks()
        if len(found):
            centroids = min(MOST_CENTROIDS, max(1, math.ceil(math.sqrt(r["most"] / cell_rows))))
            books[r["width"]] = fit_codebooks(_unit(found, r["width"]), centroids)
    return books


def near_duplicates(
    rows: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, block: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``rows``.

    Vectors with equal labels link at a cosine of ``cosine`` or more. ``sample`` bounds the vectors on
    which the codebooks are fitted, ``cell_rows`` is the number of vectors of a label that a cell
    should hold on average.

    Rows whose vector or label is null, or whose vector is empty, zero or has null or non-finite
    components, link with nothing. Vectors of different widths have no cosine and do not link. Rows
    without an id have no component and are not kept. Rows that repeat an id are separate rows; their
    links add up in the id's component. Other columns are ignored.
    """
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    keyed = _keyed(base)
    alone = F.col("vec_id").isNotNull()
    classes = cut_lineage(
        keyed.where("key is not null")
        .withColumn("width", F.size("embedding"))
        .groupBy("label", "width", "key")
        .agg(F.min("vec_id").alias("node"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    )
    books = _codebooks(classes, sample, cell_rows)
    visits = cut_lineage(_visits(classes, books, math.sqrt(max(2 - 2 * cosine, 0))))
    links = cut_lineage(_links(visits, cosine, block))
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("with").alias("b")))
    counts = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    per_class = (
        classes.select("label", "key", "node", "copies")
        .join(counts, "node", "left")
        .join(parts, "node", "left")
        .select("label", "key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    )
    out = keyed.drop("embedding").join(per_class, ["label", "key"], "left")
    component = F.when(alone, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
