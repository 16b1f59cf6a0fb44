"""Sharding by histogram sort, in DataFrame operations only.

Documents are ordered by a 60-bit key of their text, then by id, so equal texts lie together and a
text with a third of all copies is still cut between its copies. Rounds of exact counting find, for
each shard boundary, the key below which the wanted number of bytes lies: each round counts bytes
below finer probes inside the key intervals that still hold a boundary. Then every row is placed at
once, by comparison with the splitters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

KEY_BITS = 60
STEP_BITS = 12


def sort_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5 digest; the empty text's for null."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _refine(rows: DataFrame, targets: list[int], bits: int, tolerance: int) -> list[tuple[int, int, int]]:
    """For each target: the lowest key and the width in bits of an interval holding it, and the bytes below.

    ``rows`` has ``k`` (non-negative, below ``2**bits``) and ``size``. A boundary is settled when its
    interval holds at most ``tolerance`` bytes or a single key. What a round brings to the driver is
    at most ``2**STEP_BITS`` sums per boundary.
    """
    state = [(0, bits, 0)] * len(targets)
    settled = [False] * len(targets)
    while not all(settled):
        open_ = sorted({s[:2] for s, done in zip(state, settled) if not done})
        width = open_[0][1]
        step = min(STEP_BITS, width)
        narrow = width - step
        parents = [lo >> width for lo, _ in open_]
        probe = F.shiftright("k", narrow)
        counted = {
            r["p"]: r["bytes"]
            for r in rows.where(F.shiftright("k", width).isin(parents)).groupBy(probe.alias("p")).agg(F.sum("size").alias("bytes")).collect()
        }
        for i, target in enumerate(targets):
            if settled[i]:
                continue
            lo, _, below = state[i]
            for p in range(lo >> narrow, (lo >> narrow) + (1 << step)):
                here = counted.get(p, 0)
                if here and below + here > target:
                    state[i] = (p << narrow, narrow, below)
                    settled[i] = narrow == 0 or here <= tolerance
                    break
                below += here
            else:
                state[i], settled[i] = (lo + (1 << width), 0, below), True
    return state


def shard(
    docs: DataFrame, shards: int = 16, tolerance: int = 0, cell_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    The law is ``bytes``: shard ``s`` takes the rows before which ``s/shards`` to ``(s+1)/shards`` of
    all bytes lie in the order of text key and id. A row counts with the bytes of its text and one.
    With ``tolerance`` zero every boundary is exact, so shards differ by less than one document each;
    otherwise a boundary may be off by that many bytes. ``slot`` numbers the rows of a shard in the
    same order from 0.

    A null text counts as empty, with the checksum 0. Null ids come first among equal texts; rows
    alike in text and id are interchangeable. Empty input gives an empty result. Other columns of
    ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            sort_key(F.col(text_col)).alias("k"),
        )
    )
    placed = _placed(rows, shards, tolerance)
    return _slots(placed, cell_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _placed(rows: DataFrame, shards: int, tolerance: int) -> DataFrame:
    """``rows`` with their shard: the number of splitters at or below a row in (key, id) order.

    A splitter is a key, or a key with an id where copies of one text must be cut. Where the wanted
    byte falls inside a row, that row stays in the shard it begins in.
    """
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    targets = [-(-s * total // shards) for s in range(1, shards)]
    found = _refine(rows, [t - 1 for t in targets], KEY_BITS, tolerance)
    # the byte before the target lies in a row of this key; the rows from the target on begin behind it
    heavy = sorted({lo for lo, width, _ in found if width == 0})
    parts = rows.where(F.col("k").isin(heavy)).groupBy("k").agg(F.count("*").alias("n"), F.max("size").alias("one")).collect() if heavy else []
    group = {r["k"]: r for r in parts}
    number = F.lit(0)
    for (lo, width, below), target in zip(found, targets):
        if width or lo not in group:  # within tolerance, or beyond the last row
            number = number + (F.col("k") >= F.lit(lo + (1 << width))).cast("int")
            continue
        # rows of one key are copies of one text and so alike in size: the cut is at a rank among their ids
        rank = -(-(target - below) // group[lo]["one"])
        number = number + F.when(F.col("k") != F.lit(lo), (F.col("k") > F.lit(lo)).cast("int")).otherwise(_from_rank(rows, lo, rank, group[lo]["n"]))
    return rows.withColumn("shard", number.cast("int"))


def _from_rank(rows: DataFrame, key: int, rank: int, n: int) -> Column:
    """Whether a row of the text ``key`` has a rank of at least ``rank`` (from 0) in the order of ids."""
    if rank >= n:
        return F.lit(0)
    copies = rows.where(F.col("k") == key)
    nulls = copies.where("doc_id is null").count()
    if rank < nulls:
        return F.lit(1)
    # the same search over the range of ids
    ids = copies.where("doc_id is not null").select("doc_id", F.lit(1).cast("long").alias("size"))
    low = ids.agg(F.min("doc_id").alias("m")).first()["m"]
    span = ids.agg(F.max("doc_id").alias("m")).first()["m"] - low
    lo, _, _ = _refine(ids.select((F.col("doc_id") - F.lit(low)).alias("k"), "size"), [rank - nulls], max(span.bit_length(), 1), 0)[0]
    return F.coalesce((F.col("doc_id") >= F.lit(low + lo)).cast("int"), F.lit(0))


def _slots(placed: DataFrame, cell_rows: int) -> DataFrame:
    """Gapless numbers within each shard, in (key, id) order.

    Rows are numbered inside cells, which are ranges of keys of about ``cell_rows`` rows; the cells'
    counts give where each starts. A cell that a common text fills is cut by ranges of its ids.
    """
    n = placed.count()
    bits = max(0, math.ceil(math.log2(max(n, 1) / cell_rows))) + 4 if n > cell_rows else 0
    placed = placed.withColumn("cell", F.shiftright("k", KEY_BITS - bits) if bits else F.lit(0).cast("long"))
    stats = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("k").alias("one"), F.max("k").alias("last"))
    # only a cell of one text can be cut by ids and stay in order
    cut = F.when(F.col("one") == F.col("last"), F.ceil(F.col("rows") / cell_rows)).otherwise(1)
    stats = cut_lineage(stats.select("shard", "cell", "low", ((F.col("high") - F.col("low")) / cut + 1).alias("span"), cut.alias("cut")))
    part = F.when(F.col("cut") > 1, F.floor((F.coalesce("doc_id", "low") - F.col("low")) / F.col("span"))).otherwise(0)
    celled = placed.join(stats, ["shard", "cell"]).withColumn("part", part.cast("long")).drop("low", "span", "cut")
    counts = celled.groupBy("shard", "cell", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut_lineage(counts.select("shard", "cell", "part", before.alias("first")))
    inside = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy(F.col("k"), F.col("doc_id").asc_nulls_first()))
    return celled.withColumn("rank", inside).join(starts, ["shard", "cell", "part"]).withColumn("slot", F.col("first") + F.col("rank") - 1)
