"""Benchmark decontamination by the q-gram lemma and banded alignment.

Every window of an item counts, at whatever character it begins. A window of ``m`` characters that
occurs in a document with at most ``e`` edits shares at least ``m - q + 1 - q * e`` of its q-grams with
it, all of them on diagonals (document position less item position) that differ by at most ``e``. Items
are cut into overlapping chunks so long that each window lies in one. Shared q-grams are counted per
chunk in overlapping bands of diagonals; in bands that reach the bound, the windows that reach it are
found from the order of their q-grams, and an alignment inside the band, widened by the budget, decides.

Texts are compared with letter case, punctuation and white space evened out. The benchmark is read in
blocks of bounded size, each sent to all tasks; documents are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import LOWER, SMALL_SLICE_BYTES, text_slices

Q = 8
WINDOW = 80
CHUNK = 2 * WINDOW
EDIT_SHARE = 0.1
BLOCK_BYTES = 8_000_000
TABLE_BITS = 20
COUNTER_BITS = 22
SCRAMBLE = np.uint64(0x9E3779B97F4A7C15)

# letters and digits in lower case, bytes of characters beyond ASCII as they are, all else a space
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = ord(" ")


def plain(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evened-out bytes of a slice, the rows' offsets in them, and each byte's place in ``data``."""
    if len(data) == 0:
        return data, offsets, np.zeros(0, dtype=np.int64)
    out = PLAIN[data]
    # capital letters with accents: the second byte of U+00C0 to U+00DE
    out[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 0x20
    space = out == ord(" ")
    keep = ~space
    keep[1:] |= ~space[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    keep[heads] = ~space[heads]
    at = np.flatnonzero(keep)
    return out[at], np.searchsorted(at, offsets), at


def grams(text: np.ndarray) -> np.ndarray:
    """The Q bytes from each position as one number."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return np.ndarray((n,), dtype="<u8", buffer=np.ascontiguousarray(text), strides=(1,)).copy()


@dataclass
class Index:
    """Q-grams of a block of items: sorted values, where each begins, and the chunks and offsets it has.

    Items have a start in ``text``, a size, and one length and budget of edits for all their windows;
    offsets count from the item's start.
    """

    text: np.ndarray
    ids: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    spans: np.ndarray
    allowed: np.ndarray
    owners: np.ndarray
    values: np.ndarray
    first: np.ndarray
    chunks: np.ndarray
    offsets: np.ndarray
    seen: np.ndarray

    @property
    def _windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Item and offset in it of the windows at multiples of half a window and of each item's last one.

        A sample of the windows searched for, which are those at all offsets, small enough to look at one by one.
        """
        own = [np.unique(np.append(np.arange(0, n, WINDOW // 2), n - 1)) for n in self.sizes - self.spans + 1]
        return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.zeros(0, dtype=np.int64), *own])

    @property
    def starts(self) -> np.ndarray:
        """Where in ``text`` each of the sampled windows begins."""
        item, offset = self._windows
        return self.begins[item] + offset

    @property
    def lengths(self) -> np.ndarray:
        return self.spans[self._windows[0]]

    @property
    def budgets(self) -> np.ndarray:
        return self.allowed[self._windows[0]]

    @property
    def items(self) -> np.ndarray:
        return self.ids[self._windows[0]]


def build(items: list[tuple[int, str]]) -> Index:
    """Index of items' windows. An item with fewer than Q characters has no q-gram and never matches."""
    ids, texts, owners, places = [], [], [], []
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        flat, _, _ = plain(raw, np.array([0, len(raw)], dtype=np.int64))
        flat = flat[:-1] if len(flat) and flat[-1] == ord(" ") else flat
        if len(flat) < Q:
            continue
        for at in range(0, max(1, len(flat) - WINDOW + 1), CHUNK - WINDOW):
            owners.append(len(ids))
            places.append(at)
        ids.append(item)
        texts.append(flat)
    text = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    spans = np.minimum(sizes, WINDOW)
    # the lemma needs a bound of at least one shared q-gram
    allowed = np.minimum((spans * EDIT_SHARE).astype(np.int64), (spans - Q) // Q)
    code = [grams(texts[i][at:at + CHUNK]) for i, at in zip(owners, places)]
    chunk = np.repeat(np.arange(len(owners)), [len(c) for c in code])
    offset = np.concatenate([at + np.arange(len(c)) for at, c in zip(places, code)]) if code else np.zeros(0, dtype=np.int64)
    code = np.concatenate(code) if code else np.zeros(0, dtype=np.uint64)
    order = np.argsort(code, kind="stable")
    values, first = np.unique(code[order], return_index=True)
    seen = np.zeros(1 << TABLE_BITS, dtype=bool)
    seen[(values * SCRAMBLE) >> np.uint64(64 - TABLE_BITS)] = True
    return Index(
        text, np.array(ids, dtype=np.int64), np.cumsum(sizes) - sizes, sizes, spans, allowed, np.array(owners, dtype=np.int64),
        values, np.append(first, len(code)), chunk[order], offset[order], seen,
    )


def align(pattern: np.ndarray, text: np.ndarray, origin: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Least edits between each pattern and any part of its stretch of ``text`` on ``width`` diagonals.

    ``pattern`` is a matrix with one pattern a row; its first character lies at ``origin`` on the
    first diagonal. Both ends of the text are free; places outside ``low`` to ``high`` are mismatches.
    """
    span = np.arange(width)
    at = origin[:, None] + np.arange(pattern.shape[1] + width - 1)
    around = np.where((at >= low[:, None]) & (at < high[:, None]), text[np.clip(at, 0, len(text) - 1)], 0)
    row = np.zeros((len(pattern), width), dtype=np.int16)
    span = span.astype(np.int16)
    for i in range(pattern.shape[1]):
        step = row + (around[:, i:i + width] != pattern[:, i:i + 1])
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])  # a pattern character left out
        step -= span
        np.minimum.accumulate(step, axis=1, out=step)  # text characters left out
        row = step + span
    return row.min(axis=1)


def _dense(index: Index, key: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, band and offset of the windows that share enough q-grams in a band, from each shared q-gram's
    chunk and band (``key``) and its offset in the item."""
    order = np.lexsort((offset, key))
    key, offset = key[order], offset[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (offset[1:] != offset[:-1])
    key, offset = key[new], offset[new]
    item = index.owners[key >> 32]
    inside = index.spans[item] - Q
    last = np.arange(len(key)) + inside - Q * index.allowed[item]
    i = np.flatnonzero(last < len(key))
    i = i[(key[last[i]] == key[i]) & (offset[last[i]] - offset[i] <= inside[i])]
    # windows that hold all q-grams from i to the last one needed
    low = np.maximum(offset[last[i]] - inside[i], 0)
    n = np.maximum(np.minimum(offset[i], (index.sizes - index.spans)[item[i]]) - low + 1, 0)
    start = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    found = (np.repeat(item[i], n), np.repeat((key[i] & ((1 << 32) - 1)) - (1 << 30), n), start)
    order = np.lexsort(found[::-1])
    found = tuple(x[order] for x in found)
    new = np.ones(len(start), dtype=bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in found])
    return tuple(x[new] for x in found)


def matches(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, windows, edits, first byte, last byte) of the items found in the rows of a slice."""
    text, ends, places = plain(data, offsets)
    code = grams(text)
    if len(code) == 0 or len(index.values) == 0:
        return []
    at = np.flatnonzero(index.seen[(code * SCRAMBLE) >> np.uint64(64 - TABLE_BITS)])
    near = np.minimum(np.searchsorted(index.values, code[at]), len(index.values) - 1)
    hit = index.values[near] == code[at]
    at, near = at[hit], near[hit]
    row = np.searchsorted(ends, at, side="right") - 1
    whole = at + Q <= ends[row + 1]
    at, near = at[whole], near[whole]
    if len(at) == 0:
        return []
    # every chunk with a shared q-gram, and the diagonal of its item's first character in the slice's text
    count = index.first[near + 1] - index.first[near]
    slot = np.arange(count.sum()) + np.repeat(index.first[near] - (np.cumsum(count) - count), count)
    chunk, offset = index.chunks[slot], index.offsets[slot]
    band = (np.repeat(at, count) - offset) // (index.allowed[index.owners[chunk]] + 1)
    # bands overlap by half: each diagonal lies in two
    key = (chunk << 32) + (band + (1 << 30))
    key = np.concatenate([key, key - 1])
    # counts of hashed keys are upper bounds; what they leave is counted exactly
    code = ((key.view(np.uint64) * SCRAMBLE) >> np.uint64(64 - COUNTER_BITS)).view(np.int64)
    least = (index.spans - Q + 1 - Q * index.allowed)[index.owners]
    strong = np.flatnonzero(np.bincount(code, minlength=1 << COUNTER_BITS)[code] >= np.tile(least[chunk], 2))
    item, band, start = _dense(index, key[strong], np.tile(offset, 2)[strong])
    budget, length = index.allowed[item], index.spans[item]
    origin = band * (budget + 1) - budget + start
    middle = np.clip(origin + 2 * budget + 1 + length // 2, 0, len(text) - 1)
    row = np.searchsorted(ends, middle, side="right") - 1
    best: dict[tuple[int, int], list] = {}
    for m, e in {(int(m), int(e)) for m, e in zip(length, budget)}:
        chosen = np.flatnonzero((length == m) & (budget == e))
        for part in np.array_split(chosen, -(-len(chosen) // 20_000)):
            pattern = index.text[(index.begins[item[part]] + start[part])[:, None] + np.arange(m)]
            low, high = ends[row[part]], ends[row[part] + 1]
            edits = align(pattern, text, origin[part], low, high, 4 * e + 2)
            for c, d, lo, hi in zip(part[edits <= e], edits[edits <= e], low[edits <= e], high[edits <= e]):
                first = int(np.clip(origin[c] + e, lo, hi - 1))
                last = int(np.clip(first + m + e, lo, hi - 1))
                r = int(row[c])
                first, last = int(places[first] - offsets[r]), int(places[last] - offsets[r]) + 1
                old = best.setdefault((r, int(index.ids[item[c]])), [set(), int(d), first, last])
                old[0].add((int(item[c]), int(start[c])))
                old[1:] = min(old[1], int(d)), min(old[2], first), max(old[3], last)
    return [(*pair, len(windows), *rest) for pair, (windows, *rest) in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The index of each block of items, built from at most about ``block_bytes`` of text at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // block_bytes)
    for part in range(parts):
        yield build([tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()])


def _batch_matches(index: Index, column: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
    return [(first + row, *rest) for first, data, offsets in text_slices(column, SMALL_SLICE_BYTES) for row, *rest in matches(index, data, offsets)]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, item_id, windows, edits, first_byte and last_byte: one row per document row and item found in it.

    A document holds an item if a window of 80 evened-out characters of it (all of a shorter item),
    begun at any of its characters, occurs with at most a tenth as many edits. ``windows`` counts such
    windows of the item once each, ``edits`` is the least number of edits, and the bytes bound the places found in the text, to within the budget.

    Null and empty texts and items hold nothing; items without id are left out; items under 8
    characters never match. Repeated rows give repeated results. Empty tables give no rows. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, windows long, edits long, first_byte long, last_byte long"
    out = None
    for index in _blocks(benchmark, item_col, item_text, block_bytes):
        shared = rows.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                found = _batch_matches(shared.value, batch.column(1))
                ids = batch.column(0).to_pylist() if found else []
                table = [(ids[row], *rest) for row, *rest in found]
                columns = list(zip(*table)) if table else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in schema.split(", ")])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns; see :func:`contaminated`."""
    position = docs.columns.index(text_col)
    for index in _blocks(benchmark, item_col, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[m[0] for m in _batch_matches(shared.value, batch.column(position))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
