"""Repeated passages by a sparse suffix array over words.

Of every ``spread`` consecutive runs of ``gram`` words one with the smallest hash is selected, so equal
passages select equal positions. Only the suffixes at these positions are kept. They are sorted by
their first words across the cluster, with document and position behind, so that a passage that a
third of all documents share is spread over many tasks. Neighbours in that order that begin alike are
candidates; these are extended to the left up to the selected position before, and to the right, and
an extended window of ``least`` words that other documents have as well is a repeat.

The first selected position of a passage of ``least`` words lies within its first ``spread`` words, so
``least - spread + 1`` words of the passage follow it: no repeated passage is missed. Windows are
compared by 64-bit hashes; at 1e11 windows a few hundred may be taken for repeats wrongly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import BASE, SEPARATOR, hashed_words, mix, powers, signed, text_slices
from panelcast.session import cut_lineage

LEAST = 50
GRAM = 8
SPREAD = 16


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums for :func:`_windows`, and the inverse powers they need."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return total, down


def _windows(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position."""
    total, down = sums
    return mix((total[at + length] - total[at]) * down[at] + np.uint64(int(BASE) * length % (1 << 64)))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` of minimum or maximum over each run of ``width`` values."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:len(out) - step], out[step:])
        done += step
    return out


def selected(words: np.ndarray, ends: np.ndarray, least: int, gram: int, spread: int) -> np.ndarray:
    """Selected positions of a slice's words whose suffix has ``least - spread + 1`` words in its text."""
    if len(words) < least:
        return np.zeros(0, dtype=np.int64)
    sums = _sums(words)
    n = len(words) - gram + 1
    grams = _windows(sums, np.arange(n), gram)
    low = _sliding(grams, spread, np.minimum)
    # windows over the end of a text do not count; zero is below every other minimum
    end = np.repeat(ends[1:], np.diff(ends))
    inside = np.arange(len(low)) + spread + gram - 1 <= end[:len(low)]
    low = np.where(inside, low, np.uint64(0))
    padded = np.concatenate([np.zeros(spread - 1, dtype=np.uint64), low, np.zeros(spread - 1, dtype=np.uint64)])
    high = _sliding(padded, spread, np.maximum)
    at = np.flatnonzero((high == grams) & (high > 0))
    return at[at + (least - spread + 1) <= end[at]]


def suffixes(docs: DataFrame, least: int, gram: int, spread: int) -> DataFrame:
    """Hash of its first words, document and position of every selected suffix."""
    head = least - spread + 1

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in text_slices(batch.column(1)):
                words, ends = hashed_words(data, offsets)
                at = selected(words, ends, least, gram, spread)
                if len(at):
                    row = np.searchsorted(ends, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(_windows(_sums(words), at, head))), pa.array(ids[first + row]), pa.array((at - ends[row]).astype(np.int32))],
                        names=["head", "doc_id", "at"],
                    )

    return docs.mapInArrow(run, "head long, doc_id long, at int")


def _neighbours(sorted_suffixes: DataFrame) -> DataFrame:
    """Suffixes that begin like a neighbour from another document.

    The first and last run of equal beginnings of a batch may go on outside it and stay in any case;
    extension drops what has no partner.
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            head, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
            last = np.r_[first[1:], len(head)] - 1
            keep = doc[first] != doc[last]  # ids are sorted within a run
            keep[[0, -1]] = True
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], names=["doc_id", "at"]).filter(pa.array(np.repeat(keep, last - first + 1)))

    return sorted_suffixes.mapInArrow(run, "doc_id long, at int")


def _extended(rows: DataFrame, least: int, gram: int, spread: int) -> DataFrame:
    """Hash, document and start of the windows of ``least`` words around candidate positions.

    A window belongs to the first candidate in its first ``spread`` words, so each is made once.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            places = batch.column(2)
            for first, data, offsets in text_slices(batch.column(1)):
                words, ends = hashed_words(data, offsets)
                at = selected(words, ends, least, gram, spread)
                if not len(at):
                    continue
                part = places.slice(first, len(ends) - 1)
                wanted = part.flatten().to_numpy(zero_copy_only=False) + np.repeat(ends[:-1], part.value_lengths().to_numpy(zero_copy_only=False))
                at = at[np.isin(at, wanted)]
                row = np.searchsorted(ends, at, side="right") - 1
                start = np.maximum(np.maximum(np.r_[-1, at[:-1]][:len(at)] + 1, ends[row]), at - spread + 1)
                count = at - start + 1
                starts = np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)
                row = np.repeat(row, count)
                fits = starts + least <= ends[row + 1]
                starts, row = starts[fits], row[fits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(_windows(_sums(words), starts, least))), pa.array(ids[first + row]), pa.array((starts - ends[row]).astype(np.int32))],
                    names=["window", "doc_id", "start"],
                )

    return rows.mapInArrow(run, "window long, doc_id long, start int")


def repeated_windows(docs: DataFrame, least: int = LEAST, gram: int = GRAM, spread: int = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start and owner of every window of ``least`` words that at least two documents have.

    ``owner`` is the smallest id that has it. Rows without id or text have none; rows that repeat an
    id count as one document.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    kept = cut_lineage(suffixes(base, least, gram, spread))
    ordered = kept.repartitionByRange("head", "doc_id", "at").sortWithinPartitions("head", "doc_id", "at")
    places = _neighbours(ordered).groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    windows = cut_lineage(_extended(base.join(places, "doc_id").select("doc_id", "text", "places"), least, gram, spread))
    shared = windows.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last")
    return windows.join(shared.select("window", "owner"), "window").select("doc_id", "start", "owner")


def _merged(rows: DataFrame, least: int) -> DataFrame:
    """Per document the union of its windows: spans in words, end exclusive."""

    def run(batches):
        for batch in batches:
            spans = []
            for starts in batch.column(1):
                s = np.unique(starts.values.to_numpy())
                cut = np.flatnonzero(np.diff(s) > least)
                spans.append([{"start": int(a), "end": int(b) + least} for a, b in zip(s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]])])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    grouped = rows.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    return grouped.mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long>>")


def repeated_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_spans, n_repeated_words and spans of each document with a repeated passage.

    A word belongs to a repeated passage if it lies in ``least`` consecutive words, letter case aside,
    that another document has too. Spans count words from 0, end exclusive. Documents without any, of
    fewer words, empty, without text or without id have no row; empty input gives no rows. Rows that
    repeat an id are one document, with the spans of all its texts. Other columns are ignored.
    """
    spans = _merged(repeated_windows(docs, least, id_col=id_col, text_col=text_col), least)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return spans.select("doc_id", F.size("spans").cast("long").alias("n_spans"), size.alias("n_repeated_words"), "spans")


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut out of all documents but the one with the smallest id.

    All rows and columns stay; a text loses the words of its passages and the white space behind them.
    """
    later = _merged(repeated_windows(docs, least, id_col=id_col, text_col=text_col).where("doc_id <> owner"), least)
    later = later.select(F.col("doc_id").alias("_repeat_id"), F.col("spans").alias("_repeat_spans"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, _cut)

    joined = docs.join(later, F.col(id_col) == F.col("_repeat_id"), "left")
    text = F.when(F.col("_repeat_id").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("_repeat_spans")))
    return joined.withColumn(text_col, text).select(*docs.columns)


def _cut(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    inside = ~SEPARATOR[raw]
    at = np.append(np.flatnonzero(inside & ~np.r_[False, inside[:-1]]), len(raw))
    keep = np.ones(len(raw), dtype=bool)
    for s in spans:
        start, end = min(s["start"], len(at) - 1), min(s["end"], len(at) - 1)
        keep[at[start]:at[end]] = False
    return raw[keep].tobytes().decode()
