"""Manifest of a dataset as a tree of digests with fan-out three, and proofs of all rows at once.

Leaves are ordered within their source by a range partitioning and numbered by counts. Nodes are derived
in blocks of ``3**LEVELS`` consecutive nodes of one level: a task turns a block of eight levels into one
node, so a tree of n leaves takes log(n) / log(6561) rounds, and no task sees more than a block.

Proofs are octopus proofs: a block of leaves derives the nodes that its rows share from the leaves
themselves, names the few coordinates (tree, level, index) that all its proofs lack, gets each of them
once, and expands the proofs of its rows locally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

FAN = 3
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: every field as its byte count, a colon and its value, or ``-`` if null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def parents(nodes: list[str]) -> list[str]:
    return [digest(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)]


def tower(nodes: list[str], whole: int, levels: int) -> list[list[str]]:
    """Levels above a block of consecutive ``nodes``, itself first. ``whole`` is the number of nodes of
    the tree's level: a block that is all of it ends at the tree's top, others after ``levels`` levels."""
    out = [nodes]
    while whole > 1 and len(out) <= levels:
        out.append(parents(out[-1]))
        whole = -(-whole // FAN)
    return out


def siblings(at: int, count: int) -> tuple[list[int], list[int]]:
    """Indexes before and after ``at`` in its run, on a level of ``count`` nodes."""
    first = at - at % FAN
    return list(range(first, at)), list(range(at + 1, min(first + FAN, count)))


def missing(at: int, count: int, level: int = 0) -> Iterator[tuple[int, int, bool]]:
    """level, index and whether before the path, of every sibling from node ``at`` to the top."""
    while count > 1:
        before, after = siblings(at, count)
        yield from ((level, i, True) for i in before)
        yield from ((level, i, False) for i in after)
        at, count, level = at // FAN, -(-count // FAN), level + 1


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` written in the order of ``group`` and ``order`` (ascending, nulls first), with ``_pos`` (from
    0) and ``_n``, position in and size of the group. Rows of a group may lie in many tasks.

    Rows that are equal in all these columns may come in any order.
    """
    keys = [*group, *order]
    # the row's place at its scan divides even rows that are all alike
    dealt = df.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(*keys, "_scan").sortWithinPartitions(*keys)
    placed = cut_lineage(dealt.drop("_scan").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    rows = placed.withColumn("_part", part)
    ends = rows.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_c"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and task
    ends = cut_lineage(ends.select(*(F.col(g).alias(f"_of_{g}") for g in group), F.col("_part").alias("_of_part"), "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"), F.sum("_c").over(whole).alias("_n")))
    same = F.col("_part") == F.col("_of_part")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    return rows.join(ends, same).withColumn("_pos", F.col("_id") - F.col("_first") + F.col("_off")).select(*df.columns, "_pos", "_n")


def _block(level: int, levels: int, whole_levels: bool, leaves_kept: bool):
    """Nodes that a block of nodes of one level of a tree adds: all, or only the topmost."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        tree, start, n = int(pdf["tree"].iloc[0]), int(pdf["at"].iloc[0]), int(pdf["n"].iloc[0])
        made = tower(pdf["digest"].tolist(), n, levels)
        out = []
        for k, nodes in enumerate(made):
            last = k == len(made) - 1
            # leaves that are kept are in the result already
            if (last and (k > 0 or not leaves_kept)) or (k > 0 and whole_levels):
                whole = -(-n // FAN**k)
                out += [(tree, level + k, start // FAN**k + i, whole, d, last) for i, d in enumerate(nodes)]
        return pd.DataFrame(out, columns=["tree", "level", "at", "n", "digest", "last"])

    return run


def subtree(rows: DataFrame, most: int, keep_leaves: bool, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """All nodes (tree, level, at, digest) that blocks cannot derive themselves, and the top of every
    tree (tree, digest), from ``rows`` (tree, at, n, digest): the leaves of trees of up to ``most`` leaves.

    Without ``keep_leaves`` the levels below ``levels`` are left out: blocks of leaves derive them.
    """
    nodes, level, current, block = [], 0, rows, FAN**levels
    while True:
        grouped = current.groupBy("tree", F.floor(F.col("at") / block).alias("block"))
        made = cut_lineage(grouped.applyInPandas(_block(level, levels, keep_leaves or level > 0, keep_leaves), "tree long, level int, at long, n long, digest string, last boolean"))
        if level == 0 and keep_leaves:
            nodes.append(rows.select("tree", F.lit(0).alias("level"), "at", "n", "digest", F.lit(False).alias("last")))
        nodes.append(made)
        most = -(-most // block)
        level += levels
        if most <= 1:
            break
        current = made.where("last and n > 1").select("tree", "at", "n", "digest")
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    return every.select("tree", "level", "at", "digest"), every.where("n = 1").select("tree", "digest")


def manifest(docs: DataFrame, fields: list[Column], source: Column, order: Column, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Every row of ``docs`` with its proof: leaf, tampered_leaf, source, subroot, root, proof_sha256,
    folded_root and verified, after the columns ``key`` and ``source``.

    ``order`` (kept as ``key``) orders a source's leaves, nulls first; rows of equal order come by their
    digest. Sources are ordered as bytes, null first. ``tampered`` is the digest of a leaf as it is found
    now, folded with the siblings of the original one. Any column may be null; no rows: no result.
    """
    own, block = leaf(fields), FAN**levels
    # digests are written, so that long rows are read once
    rows = cut_lineage(docs.select(order.alias("key"), source.cast("string").alias("source"), own.alias("leaf"), (own if tampered is None else tampered).alias("tampered_leaf")))
    leaves = numbered(rows, ["source"], ["key", "leaf", "tampered_leaf"])
    sources = numbered(leaves.groupBy("source").agg(F.max("_n").alias("leaves")), [], ["source"])
    sources = cut_lineage(sources.withColumnsRenamed({"_pos": "tree", "_n": "trees"}))
    size = sources.agg(F.max("leaves"), F.max("trees")).first()
    if size[0] is None:
        none = {"subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
        return rows.withColumns({c: F.lit(None).cast(k) for c, k in none.items()})
    # one row per source, and of a source's rows as many lie together as in a task of the numbering
    named = sources.select(F.col("source").alias("_source"), "tree", "trees")
    placed = cut_lineage(leaves.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumnsRenamed({"_pos": "at", "_n": "n", "leaf": "digest"}))
    nodes, subroots = subtree(placed.select("tree", "at", "n", "digest"), size[0], False, levels)
    tops = cut_lineage(subroots)
    upper, root = subtree(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(size[1]).alias("n"), "digest"), size[1], True, levels)
    apex = root.first()["digest"]
    every = nodes.unionByName(upper)
    blocks = placed.groupBy("tree", F.floor(F.col("at") / block).alias("block")).agg(F.max("n").alias("n"), F.max("trees").alias("trees"))

    def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for tree, place, n, trees in pdf.itertuples(index=False):
                above = -(-n // block)
                # the siblings of a block's node begin at its level, those of a small tree at its top
                path = [(tree, *m) for m in missing(place, above, levels)] + [(TOP, *m) for m in missing(tree, trees)]
                out += [(tree, place, step, *m) for step, m in enumerate(path)]
            yield pd.DataFrame(out, columns=["of", "block", "step", "tree", "level", "at", "before"])

    asked = blocks.mapInPandas(wanted, "of long, block long, step int, tree long, level int, at long, before boolean")
    fetched = cut_lineage(asked.join(every, ["tree", "level", "at"]).select(F.col("of").alias("tree"), "block", "step", F.col("tree").alias("in_tree"), "level", "before", "digest"))
    kind = rows.schema["key"].dataType.simpleString()

    def expand(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        n = int(rows["n"].iloc[0])
        own = tower(rows["digest"].tolist(), n, levels)
        path: list[tuple[tuple, list[str], list[str]]] = []
        for step in above.sort_values("step").itertuples(index=False):
            if not path or path[-1][0] != (step.in_tree, step.level):
                path.append(((step.in_tree, step.level), [], []))
            path[-1][1 if step.before else 2].append(step.digest)
        # levels whose run is one node have no siblings, but are folded all the same
        known = {key: (left, right) for key, left, right in path}
        tree, trees = int(rows["tree"].iloc[0]), int(rows["trees"].iloc[0])
        steps = []
        for of, level, count in [(tree, levels, -(-n // block)), (TOP, 0, trees)]:
            while count > 1:
                steps.append((of, *known.get((of, level), ([], []))))
                level, count = level + 1, -(-count // FAN)
        rest = "".join("".join(left + right) for _, left, right in steps)

        def climb(node: str) -> tuple[str, str]:
            """Subroot and root above the top node of the block."""
            sub = None
            for of, left, right in steps:
                if of == TOP and sub is None:
                    sub = node
                node = digest([*left, node, *right])
            return sub or node, node

        subroot, whole = climb(own[-1][0])
        proofs, folds = [], []
        for i, (old, new) in enumerate(zip(rows["digest"], rows["tampered_leaf"])):
            around, at, node = [], i, new
            for nodes in own[:-1]:
                first = at - at % FAN
                left, right = nodes[first:at], nodes[at + 1:first + FAN]
                around += left + right
                if new != old:
                    node = digest([*left, node, *right])
                at //= FAN
            proofs.append(digest([*around, rest]))
            # an unchanged leaf folds into the nodes that the block has derived
            folds.append(whole if new == old else climb(node)[1])
        out = rows[["key", "source", "digest", "tampered_leaf"]].assign(subroot=subroot, root=apex, proof_sha256=proofs, folded_root=folds)
        out["verified"] = out["folded_root"] == apex
        return out

    grouped = placed.withColumn("block", F.floor(F.col("at") / block)).withColumn("key", F.col("key").cast("string")).groupBy("tree", "block")
    schema = "key string, source string, leaf string, tampered_leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    done = grouped.cogroup(fetched.groupBy("tree", "block")).applyInPandas(lambda a, b: expand(a, b).rename(columns={"digest": "leaf"}), schema)
    return done.withColumn("key", F.col("key").cast(kind))


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``manifest`` of documents by source, in the order of their ids. In rows of even checksums of the id
    the line feeds of the text count as tampered away, nulls and other rows stay as they are."""
    field = [F.col(c) for c in FIELDS]
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    hurt = [*field[:-1], F.replace(F.col("text"), F.lit("\n"))]
    found = manifest(docs, field, F.col("source"), F.col("doc_id"), F.when(even, leaf(hurt)).otherwise(leaf(field)), levels)
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
