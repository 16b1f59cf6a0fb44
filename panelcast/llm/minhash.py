"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles, and its sketch the ``k`` smallest of
them. Inverted lists of retained values propose pairs, the sketch of the union estimates their
similarity, and the exact Jaccard similarity of the full sets decides.

Documents with equal sets form a class and are compared once. Inverted lists up to ``short`` classes
propose all their pairs, which is a bounded number. Where most of a class's values lie in longer lists,
it is first compared with one hub of each. What then lies in different components is compared again:
through the values of each sketch that are rare among those classes, and, for classes that have few
rare values and so must share common ones, set by set in blocks of bounded size, which give out only
the links found. A family of n such texts that stay apart costs n**2 comparisons inside tasks; all
other work is in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import SMALL_SLICE_BYTES, hashed_words, matching, mix, signed, text_slices
from panelcast.llm.components import connected_components
from panelcast.session import cut_lineage

SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>"


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row's text; a shorter text is one shingle."""
    weights = mix(np.arange(1, words + 1, dtype=np.uint64))
    for _, data, offsets in text_slices(column, SMALL_SLICE_BYTES):
        hashes, ends = hashed_words(data, offsets)
        n = len(hashes) - words + 1
        grams = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(words if n > 0 else 0):
            grams += mix(hashes[j:j + n] * weights[j])
        grams = mix(grams)
        for lo, hi in zip(ends[:-1], ends[1:]):
            if hi - lo >= words:
                yield np.unique(grams[lo:hi - words + 1])
            elif hi > lo:
                yield mix(np.atleast_1d(mix(hashes[lo:hi] * weights[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)))
            else:
                yield np.zeros(0, dtype=np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(flat)))


def signatures(docs: DataFrame, words: int, k: int) -> DataFrame:
    """Per row: size of the set, a 128-bit fingerprint of it, and its ``k`` smallest hashes."""

    def run(batches):
        for batch in batches:
            size, a, b, sketch = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                size.append(len(s))
                a.append(int(mix(s).sum(dtype=np.uint64)))
                b.append(int(mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)))
                sketch.append(s[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), *(pa.array(signed(np.array(x, dtype=np.uint64))) for x in (a, b)), _lists(sketch)],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
            )

    return docs.mapInArrow(run, SIGNATURE)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(shingle_sets(batch.column(1), words)))], names=["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes array<long>")


def _close(a: str, b: str, percent: int) -> str:
    """Sizes that allow a similarity of ``percent``."""
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _short_lists(entries: DataFrame, percent: int, short: int) -> DataFrame:
    left = entries.where(F.col("members") <= short)
    right = left.select("value", F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = left.withColumnsRenamed({"node": "a", "n": "na"}).join(right, "value").where("a < b").where(_close("na", "nb", percent))
    return pairs.select("a", "b")


def _with_members(entries: DataFrame) -> DataFrame:
    """Entries of the inverted lists that at least two classes share, with the lists' lengths."""
    members = entries.groupBy("value").agg(F.count("*").alias("members")).where("members > 1")
    return entries.join(members, "value")


def _enough(prefix: int, percent: int, chance: float = 1e-6) -> int:
    """How many of ``prefix`` values must lie outside long lists, so that those find a link.

    A link leaves at most 1 - percent of all values unshared, so all of ``m`` with the chance below.
    """
    unshared = prefix * (1 - percent / 100)
    return next((m for m in range(1, prefix) if unshared < m and (unshared / m) ** m <= chance), prefix)


def near_duplicates(
    docs: DataFrame, words: int = 3, percent: int = 85, k: int = 64, prefix: int = 16, short: int = 24, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Texts link if ``100 * shared >= percent * united`` on their full shingle sets; ``component_id`` is
    the smallest id reachable. ``k`` is the size of a sketch, ``prefix`` how many of its values have
    inverted lists: two texts at the limit of 0.85 share none of 16 with a probability of 1e-13.

    Null, empty and wordless texts have an empty set and link with nothing. Rows without an id keep a
    null component and are never ``kept``. Rows that repeat an id stay separate rows whose links both
    count for the id. Other columns of ``docs`` are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = cut_lineage(signatures(base, words, k))
    classes = cut_lineage(
        marked.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
        .withColumnRenamed("n_shingles", "n")
    )
    enough = _enough(prefix, percent)
    lists = cut_lineage(_with_members(classes.select("node", "n", F.explode(F.slice("sketch", 1, prefix)).alias("value"))))
    crowded = lists.where(F.col("members") > short).groupBy("node", "n").agg(F.collect_list("value").alias("long"))
    crowded = crowded.where(F.size("long") > (1 - enough / prefix) * F.least("n", F.lit(prefix)))
    long_lists = cut_lineage(crowded.select("node", "n", F.explode("long").alias("value")))
    hubs = long_lists.groupBy("value").agg(F.min(F.struct("node", "n")).alias("hub"))
    to_hub = long_lists.join(hubs, "value").where("node <> hub.node").where(_close("n", "hub.n", percent))
    first = _short_lists(lists, percent, short).union(to_hub.select(F.col("hub.node").alias("a"), F.col("node").alias("b")))
    links = _confirmed(first, classes, base, words, percent)
    parts = cut_lineage(connected_components(links))

    more = _remainder(classes, long_lists, parts, base, words, percent, prefix, short)
    if more is not None:
        parts = cut_lineage(connected_components(links.union(more)))

    found = classes.join(parts, "node", "left").select("set_a", "set_b", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    out = marked.drop("sketch").join(found, ["set_a", "set_b", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _remainder(
    classes: DataFrame, long_lists: DataFrame, parts: DataFrame, base: DataFrame, words: int, percent: int, prefix: int, short: int
) -> DataFrame | None:
    """Links among classes of long lists that lie in different components."""
    entries = long_lists.join(parts, "node", "left").select("value", "node", "n", F.coalesce("component", "node").alias("part"))
    sizes = entries.groupBy("value", "part").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("value").agg(F.max(F.struct("size", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    entries = cut_lineage(entries.join(mixed.select("value", F.col("main.part").alias("main")), "value"))
    if entries.isEmpty():
        return None
    pool = entries.select("node").distinct()
    values = cut_lineage(classes.join(pool, "node").select("node", "n", F.posexplode("sketch").alias("rank", "value")))
    members = values.groupBy("value").agg(F.count("*").alias("members"))
    values = cut_lineage(values.join(members, "value").withColumn("rare", F.col("members") <= short))
    # a link leaves up to 1 - percent of a sketch unshared; from 0.15 more on it shares ten rare values of 64 in expectation
    few = values.groupBy("node").agg(F.avg(F.col("rare").cast("int")).alias("share")).where(F.col("share") <= 1.15 - percent / 100 + 1e-9).select("node")
    links = _confirmed(_short_lists(values.where("rare and members > 1"), percent, short), classes, base, words, percent)
    return links.union(_block_links(entries.join(few, "node"), base, words, percent)).distinct()


def _block_links(entries: DataFrame, base: DataFrame, words: int, percent: int, lists: int = 8, block: int = 400_000, block_rows: int = 2_048) -> DataFrame:
    """Links between members outside a list's largest component and its other members.

    Each member compares in its ``lists`` first long lists. A list is cut into blocks of about
    ``block`` shingles and ``block_rows`` members, whichever are smaller, and every two blocks meet in one group; a member gives out one link per
    component that it meets there.
    """
    ordered = entries.groupBy("node", "n", "part").agg(F.slice(F.array_sort(F.collect_list(F.struct("value", "main"))), 1, lists).alias("own"))
    rows = cut_lineage(ordered.select("node", "n", "part", F.explode("own").alias("e")).select("node", "n", "part", "e.value", "e.main"))
    loads = rows.groupBy("value").agg(F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count("*") / block_rows)).cast("int").alias("blocks"), F.max(F.col("part") != F.col("main")).alias("open")).where("open")
    rows = cut_lineage(rows.join(loads.select("value", "blocks"), "value").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    sets = full_sets(matching(base, rows.select(F.col("node").alias("doc_id")), "doc_id"), words)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = F.transform(others, lambda to: F.struct(F.col("at").alias("i"), to.alias("j"), F.lit(True).alias("outside")))
    right = F.transform(others, lambda to: F.struct(to.alias("i"), F.col("at").alias("j"), F.lit(False).alias("outside")))
    meets = F.when(F.col("part") != F.col("main"), F.concat(left, right)).otherwise(right)
    met = rows.join(sets, "node").select("value", F.explode(meets).alias("meet"), "node", "part", "hashes").select("value", "meet.*", "node", "part", "hashes")

    def run(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy()
        node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
        hashes = table.column("hashes").combine_chunks()
        flat, size = hashes.flatten().to_numpy(), hashes.value_lengths().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(node)), size)
        _, code = np.unique(flat, return_inverse=True)
        both = np.zeros(code.max(initial=-1) + 1, dtype=np.int8)
        both[code[outside[owner]]] |= 1
        both[code[~outside[owner]]] |= 2
        at = np.cumsum(both == 3) - 1
        use = both[code] == 3
        owner, code = owner[use], at[code[use]]
        a, b = np.flatnonzero(outside), np.flatnonzero(~outside)
        place = np.cumsum(outside) - 1
        place[b] = np.arange(len(b))
        shared = np.zeros((len(a), len(b)), dtype=np.float32)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            s = slice(*np.searchsorted(code, [lo, lo + 2048]))
            x, y = np.zeros((len(a), 2048), dtype=np.float32), np.zeros((len(b), 2048), dtype=np.float32)
            o, c, left_side = owner[s], code[s] - lo, outside[owner[s]]
            x[place[o[left_side]], c[left_side]] = 1
            y[place[o[~left_side]], c[~left_side]] = 1
            shared += x @ y.T
        union = size[a][:, None] + size[b][None, :] - shared
        linked = (100 * shared >= percent * union) & (part[a][:, None] != part[b][None, :])
        i, j = np.nonzero(linked)
        _, first = np.unique(np.column_stack([i, part[b[j]]]), axis=0, return_index=True)
        return pa.table({"a": pa.array(node[a[i[first]]], pa.int64()), "b": pa.array(node[b[j[first]]], pa.int64())})

    return cut_lineage(met.groupBy("value", "i", "j").applyInArrow(run, "a long, b long"))


def _confirmed(pairs: DataFrame, classes: DataFrame, base: DataFrame, words: int, percent: int, k: int = 24) -> DataFrame:
    """The proposed pairs whose full sets are similar enough, after an estimate from ``k`` values of their sketches."""
    near = cut_lineage(pairs.distinct())
    nodes = near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node")))
    side = matching(classes.select("node", F.slice("sketch", 1, k).alias("sketch")), nodes, "node")
    for end in ("a", "b"):
        near = near.join(side.select(F.col("node").alias(end), F.col("sketch").alias(f"s{end}")), end)
    near = near.withColumn("union", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    shared = F.size(F.array_intersect("union", F.array_intersect("sa", "sb")))
    t = percent / 100
    slack = 6 * (t * (1 - t) / k) ** 0.5
    near = cut_lineage(near.where(shared >= F.size("union") * (t - slack)).select("a", "b"))
    nodes = near.select(F.col("a").alias("doc_id")).union(near.select(F.col("b").alias("doc_id")))
    sets = cut_lineage(full_sets(matching(base, nodes, "doc_id"), words))
    for end in ("a", "b"):
        near = near.join(sets.select(F.col("node").alias(end), F.col("hashes").alias(f"h{end}")), end)
    both = F.size(F.array_intersect("ha", "hb"))
    near = near.select("a", "b", both.alias("both"), (F.size("ha") + F.size("hb") - both).alias("either"))
    return cut_lineage(near.where(F.col("both") * 100 >= F.col("either") * percent).select("a", "b").distinct())
