"""Token ids in ORC files: run-length encoded integers in stripes, with row indexes and Bloom filters.

Documents are dealt out by ranges of ids and encoded in order inside each task, so the files in order
of their names hold the documents in order of their ids. A reader prunes stripes and row groups by the
indexes of ``doc_id`` and its Bloom filter, and takes stripes in parallel.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import mix, powers, text_slices
from panelcast.session import cut_lineage

END_ID = 0
MOST_PIECES = 1_000_000
SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"

# a piece of Latin letters is one word to the tokenizer: its model can take it as it is
LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# how byte-level models write bytes: visible characters as they are, the others from U+0100 on
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}
SPACE = chr(BYTE_CHARACTERS[0x20])

# the other ASCII bytes end a run of these, which is a word to the tokenizer
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
ASCII_OTHER = ~LETTER & (np.arange(256) < 0x80)
# bytes below 0x80 behind which a space does not begin a piece: white space and controls
BLANK = np.zeros(256, dtype=bool)
BLANK[[*range(0x21), 0x7F]] = True
# first two bytes of three-byte characters among which white space lies, and its two-byte ones
BLANK_THREE = (0xE19A, 0xE280, 0xE281, 0xE380)
BLANK_TWO = (0xC285, 0xC2A0)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at every text, at every space behind a character that is no white space, and at
    every other ASCII character that is no letter behind an ASCII letter.

    The tokenizer splits words off with the space ahead of them, and letters from what else follows them, so no
    token crosses such a place, and what lies before does not depend on what follows.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    at = at[~BLANK[data[at - 1]]]
    wide = np.flatnonzero(data[at - 1] >= 0x80)
    if len(wide):
        last, second = data[at[wide] - 1].astype(np.int64), data[np.maximum(at[wide] - 2, 0)].astype(np.int64)
        third = data[np.maximum(at[wide] - 3, 0)].astype(np.int64)
        doubtful = np.zeros(len(wide), dtype=bool)
        for pair in BLANK_TWO:
            doubtful |= (second << 8 | last) == pair
        for pair in BLANK_THREE:
            doubtful |= (third << 8 | second) == pair
        at = np.delete(at, wide[doubtful])
    starts = np.zeros(len(data), dtype=bool)
    starts[at] = True
    starts[1:] |= LETTER[data[:-1]] & ASCII_OTHER[data[1:]]
    starts[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(starts)


def _heads(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Up to eight first bytes of each piece as a number."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for i in range(8):
        inside = lengths > i
        out[inside] |= data[starts[inside] + i].astype(np.uint64) << np.uint64(8 * i)
    return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in ascending order, where each is first, and the place of every value among them."""
    encoded = pa.array(hashes).dictionary_encode()
    found, codes = encoded.dictionary.to_numpy(), encoded.indices.to_numpy()
    # codes are given in order of first appearance
    first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
    order = np.argsort(found)
    place = np.empty(len(found), dtype=np.int64)
    place[order] = np.arange(len(found))
    return found[order], first[order], place[codes]


class Encoder:
    """Encodes texts piece by piece and keeps the ids of up to ``MOST_PIECES`` pieces.

    A piece is known by a 64-bit hash, its length and its first eight bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keys, self.heads = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.sizes, self.starts, self.counts, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.pool = np.zeros(0, dtype=np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice with the end id behind each, and the numbers of ids per text."""
        starts = piece_starts(data, offsets)
        per_text = np.diff(np.searchsorted(starts, offsets))
        if not len(starts):
            return np.full(len(per_text), END_ID, dtype=np.int32), np.ones(len(per_text), dtype=np.int64)
        up, down = powers(len(data))
        values = data.astype(np.uint64)
        values += np.uint64(1)
        values *= up
        sizes = np.diff(np.append(starts, len(data)))
        hashes = mix(np.add.reduceat(values, starts) * down[starts])
        keys, first, inverse = _distinct(hashes)
        where, count, pool = self._found(data, keys, starts[first], sizes[first])
        where, count = where[inverse], count[inverse]
        # ids of every piece in order, leaving one place behind each text
        text = np.repeat(np.arange(len(per_text)), per_text)
        ends = np.cumsum(count)
        place = ends - count + text
        out = np.full(int(ends[-1]) + len(per_text), END_ID, dtype=np.int32)
        inside = np.arange(int(ends[-1])) - np.repeat(ends - count, count)
        out[inside + np.repeat(place, count)] = pool[inside + np.repeat(where, count)]
        totals = np.bincount(text, weights=count, minlength=len(per_text)).astype(np.int64) + 1
        return out, totals

    def _found(self, data, keys, starts, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct piece's ids begin, how many they are, and the ids."""
        heads = _heads(data, starts, sizes)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            known = (self.keys[at] == keys) & (self.heads[at] == heads) & (self.sizes[at] == sizes)
            self.uses[at[known]] += 1
        where, count = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        where[known], count[known] = self.starts[at[known]], self.counts[at[known]]
        new = np.flatnonzero(~known)
        raw = data.tobytes()
        pieces = [raw[a:a + n] for a, n in zip(starts[new].tolist(), sizes[new].tolist())]
        plain = [LETTERS.fullmatch(p) is not None for p in pieces]
        others = iter(self.tokenizer.encode_batch_fast([p.decode() for p, letters in zip(pieces, plain) if not letters], add_special_tokens=False))
        word = self.tokenizer.model.tokenize
        ids = array("i")
        lengths = []
        for p, letters in zip(pieces, plain):
            if letters:
                visible = p.decode("latin-1")
                # of ASCII only the space is written as another character
                found = [t.id for t in word(visible.replace(" ", SPACE) if p.isascii() else visible.translate(BYTE_CHARACTERS))]
            else:
                found = next(others).ids
            ids.extend(found)
            lengths.append(len(found))
        count[new] = lengths
        where[new] = len(self.pool) + np.cumsum(count[new]) - count[new]
        pool = np.concatenate([self.pool, np.frombuffer(ids, dtype=np.int32)])
        self._remember(pool, keys[new], heads[new], sizes[new], where[new], count[new])
        return where, count, pool

    def _remember(self, pool, keys, heads, sizes, starts, counts) -> None:
        if len(self.keys) + len(keys) > MOST_PIECES:  # keep what was used again
            keep = np.flatnonzero(self.uses > 0)[:MOST_PIECES // 2]
            at = np.repeat(self.starts[keep], self.counts[keep])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(self.counts[keep]) - self.counts[keep], self.counts[keep])
            self.pool = self.pool[at + inside]
            self.keys, self.heads, self.sizes, self.counts = (x[keep] for x in (self.keys, self.heads, self.sizes, self.counts))
            self.starts, self.uses = np.cumsum(self.counts) - self.counts, np.zeros(len(keep), dtype=np.int64)
            return
        at = np.searchsorted(self.keys, keys)
        unlike = np.ones(len(keys), dtype=bool)  # of two pieces with one hash the first stays
        if len(self.keys):
            unlike = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        at = at[unlike]
        self.pool = pool
        for name, new in (("keys", keys), ("heads", heads), ("sizes", sizes), ("starts", starts), ("counts", counts), ("uses", np.zeros(len(keys), dtype=np.int64))):
            setattr(self, name, np.insert(getattr(self, name), at, new[unlike]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which keeps its pieces from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write doc_id and token ids of every row of ``docs`` to ORC files in the order of ids.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. A null text is empty
    and has only the end id. Null ids come first; rows that repeat an id stand together. Each row also
    has the number of its part and the tokens before it in that part. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(1)):
                ids, lengths = encoder(tokenizer).encode(data, offsets)
                ahead = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(lengths)),
                        pa.array(np.full(len(lengths), part, dtype=np.int32)),
                        pa.array(ahead),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "before", "n_tokens", "ids"],
                )

    encoded = ordered.mapInArrow(run, SCHEMA)
    encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, before, n_tokens and ids; filters on ``doc_id`` prune stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of token files, all read from the files."""
    tokens = read_tokens(spark, path)

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            ends = lists.offsets.to_numpy()
            raw = np.ascontiguousarray(lists.values.to_numpy().astype("<u4")).view(np.uint8)
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            lengths = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lengths, pa.array(sums, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    # one row per part of the files
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut_lineage(parts.select(F.col("part").alias("of"), F.coalesce(ahead, F.lit(0)).alias("first")))
    read = tokens.select("doc_id", "part", "before", "ids").mapInArrow(run, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    return read.join(starts, F.col("part") == F.col("of")).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
