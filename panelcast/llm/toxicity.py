"""Toxicity from two class-conditional Kneser-Ney models.

Bigram models of toxic and of ordinary text are counted from all labelled documents but a held-out fifth
and a bounded sample for the curve. Both back off from
bigram to word to one distribution of words that they share, with backoff weights that they share too,
so an expression that is rare or new speaks for neither. A document's score comes from the difference
of its log-likelihoods by length, its length, and the differences of its three most toxic words in
their context, through a logistic curve fitted on the sample.

Counts and ratios are tables. The most frequent entries, of bounded number, go to every task; words and
bigrams of texts that these do not settle are joined with the others by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import BROADCAST_IDS, SMALL_SLICE_BYTES, hashed_words, matching, signed, text_slices
from panelcast.session import cut_lineage

# taken from every count; the one that predicts best labelled rows that were not counted is used
DISCOUNTS = (0.75, 1.5, 2.5)
FIT_ROWS = 8_000
FOLDS = 5
COUNT_SHARE = 0.7
# words, and as many bigrams, that go to every task: 64 MB each
ENTRIES = 4_000_000
TOP = 3
EVIDENCE = 0.5
WIDTH = 2 + TOP
# words are told apart by 32 bits of their hashes, so that a bigram is one number
HALF = np.uint64(32)
START = np.uint64(0x5851F42D)
# bigrams that a task holds before it passes them on
HELD = 2_000_000
# rows of a batch of counts that a task passes on
OUT_ROWS = 100_000


@dataclass
class Model:
    """Log-likelihood ratios by hash of word and of bigram (sorted), and the logistic curve.

    ``rare_words`` and ``rare_pairs`` are tables of key and ratio with the entries that the arrays lack.
    """

    words: np.ndarray
    word_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    curve: np.ndarray
    rare_words: DataFrame | None = None
    rare_pairs: DataFrame | None = None


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from: a fifth of ids, by checksum."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of rows: word hashes, hashes of the word before (or of a text's start), row ends."""
    for _, data, offsets in text_slices(column, SMALL_SLICE_BYTES):
        words, ends = hashed_words(data, offsets)
        words = words >> HALF
        before = np.empty_like(words)
        before[1:] = words[:-1]
        heads = ends[:-1][ends[:-1] < len(words)]
        before[heads] = START
        yield words, before, ends


def _pair(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (before << HALF) | words


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: np.ndarray) -> np.ndarray:
    if len(keys) == 0 or len(wanted) == 0:
        return default
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _summary(ratio: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(ratio)]
    n = np.diff(ends)
    x = np.zeros((len(n), WIDTH))
    x[:, 0] = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1)
    x[:, 1] = np.log1p(n)
    at = np.flatnonzero(ratio > EVIDENCE)
    row = np.searchsorted(ends, at, side="right") - 1
    order = np.lexsort((-ratio[at], row))
    at, row = at[order], row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    first = rank < TOP
    x[row[first], 2 + rank[first]] = ratio[at[first]] - EVIDENCE
    return x


def features(model: Model, column: pa.Array) -> np.ndarray:
    """Per row: log-likelihood difference by length, logarithm of the length, and by how much the
    ``TOP`` largest differences of single words exceed ``EVIDENCE``; zeros without words."""
    out = []
    for words, before, ends in _tokens(column):
        ratio = _lookup(model.words, model.word_ratio, words, np.zeros(len(words)))
        out.append(_summary(_lookup(model.pairs, model.pair_ratio, _pair(before, words), ratio), ends))
    return np.concatenate(out) if out else np.zeros((0, WIDTH))


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), (x - model.center) / model.scale]) @ model.curve
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and their two counts, summed by key; ``parts`` is emptied, so that it and the sums are not held together."""
    columns = [list(x) for x in zip(*parts)]
    parts.clear()
    key = np.concatenate(columns[0])
    columns[0].clear()
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key = key[first] if len(key) else key
    sums = []
    for column in columns[1:]:
        counts = np.concatenate(column)
        column.clear()
        sums.append(np.add.reduceat(counts[order], first) if len(key) else counts)
    return [(key, *sums)] if len(key) else []


def _counts(rows: DataFrame) -> DataFrame:
    """Bigrams of ``rows`` (toxic, text) as numbers, with toxic and ordinary counts; a task adds up its own."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            done = 0
            for words, before, ends in _tokens(batch.column(1)):
                toxic = np.repeat(label[done:done + len(ends) - 1], np.diff(ends)).astype(np.int32)
                done += len(ends) - 1
                # a slice is added up by itself first: what is held is shorter
                parts += _added([(_pair(before, words), toxic, 1 - toxic)])
                held += len(parts[-1][0]) if len(words) else 0
                if held > 2 * HELD:
                    parts = _added(parts)
                    held = len(parts[0][0])
                    if held > HELD:
                        yield from out(parts)
                        parts, held = [], 0
        parts = _added(parts) if parts else []
        if parts:
            yield from out(parts)

    def out(parts):
        ((key, t, o),) = parts
        for at in range(0, len(key), OUT_ROWS):
            here = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key[here])), pa.array(t[here], pa.int32()), pa.array(o[here], pa.int32())], names=["key", "t", "o"])

    return rows.mapInArrow(run, "key long, t int, o int").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _halves(bigrams: DataFrame) -> DataFrame:
    """``bigrams`` with the numbers of their first and second words."""
    return bigrams.withColumns({"u": F.shiftrightunsigned("key", 32), "w": F.col("key").bitwiseAND(F.lit((1 << 32) - 1))})


def _columns(df: DataFrame) -> list[np.ndarray]:
    """Columns of ``df`` as arrays of their own, with no Arrow memory kept behind them."""
    table = df.toArrow()
    out = [table.column(i).to_numpy() for i in range(table.num_columns)]
    out = [x if x.base is None else x.copy() for x in out]
    del table
    pa.default_memory_pool().release_unused()
    return out


def _packed(df: DataFrame) -> tuple[np.ndarray, ...]:
    """The first column of ``df`` in ascending order, and the others beside it, as numbers of 32 bits."""
    columns = _columns(df.select(*(F.col(c).cast("int" if i else "long").alias(c) for i, c in enumerate(df.columns))))
    order = np.argsort(columns[0])
    return columns[0].astype(np.uint32)[order], *(c[order] for c in columns[1:])


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be joined by key: sent to all tasks up to a counted bound."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def _pair_quotients(key, bt, bo, ut, uo, n, n1, n2, wt, wo, t: int, o: int, left: list[float]) -> list[np.ndarray]:
    """Per discount, the toxic probability of bigrams over the ordinary one; NaN where the word alone decides.

    Counts are those of the bigram, of its context (with the numbers of its bigrams, and of those of one
    and two) and of the contexts that have its word, by class.
    """
    out = []
    for d, rest in zip(DISCOUNTS, left):
        # what is left of a context's counts after the discount: those of one or two may lose all
        spent = sum((x * (c - d) for c, x in ((1, n1), (2, n2)) if c <= d), np.float64(0.0))
        behind = 1 - (ut + uo - d * n - spent) / (ut + uo)
        shared = (1 - rest / (t + o)) * (wt + wo) / (t + o)
        p, q = (np.maximum(b - d, 0.0) / u + behind * (np.maximum(w - d, 0.0) / whole + shared) for b, u, w, whole in ((bt, ut, wt, t), (bo, uo, wo, o)))
        decides = (np.maximum(bt, bo) > d) & (behind > 0)
        out.append(np.where(decides, np.divide(p, q, out=np.ones_like(p), where=decides), np.nan))
    return out


def _ratio_tables(bigrams: DataFrame, sent: int = BROADCAST_IDS) -> tuple[DataFrame, DataFrame] | None:
    """Words and bigrams with their hash, count, and ratio per discount (r0, r1, ...).

    A bigram's ratio is null where it is the ratio of its second word: where neither class has more than
    the discount of it, or one class lacks the first word. None unless both classes have words.
    Up to ``sent`` words and contexts go to every task as arrays (12 and 24 bytes each); beyond that, or with
    counts of more than 31 bits, they are joined.
    """
    bigrams = _halves(bigrams)
    known = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
    words = cut_lineage(bigrams.groupBy("w").agg(known("t"), known("o")))
    kept = lambda d: F.sum(F.greatest(F.col("t") + F.col("o") - F.lit(d), F.lit(0.0)))
    n, t, o, *left = words.agg(F.count("*"), F.sum("t"), F.sum("o"), *map(kept, DISCOUNTS)).first()
    if not t or not o:
        return None
    total = F.col("t") + F.col("o")

    def word_share(c: str, i: int) -> Column:
        """Probability of a word of counts t and o in class ``c``, with discount ``i``."""
        shared = (1 - left[i] / (t + o)) * total / (t + o)
        return F.greatest(F.col(c) - F.lit(DISCOUNTS[i]), F.lit(0.0)) / {"t": t, "o": o}[c] + shared

    once, twice = (F.sum((F.col("t") + F.col("o") == c).cast("long")).alias(f"n{c}") for c in (1, 2))
    first = bigrams.groupBy("u").agg(F.sum("t").alias("ut"), F.sum("o").alias("uo"), F.count("*").alias("n"), once, twice).where("ut > 0 and uo > 0")
    first = cut_lineage(first)
    names = ["key", "t", "o", "ut", "uo", "n", "n1", "n2", "wt", "wo"]
    shared = None
    contexts, most = first.agg(F.count("*"), F.max(F.greatest("ut", "uo"))).first()
    if max(n, contexts) <= sent and max(t, o, most or 0) < 1 << 31:
        shared = bigrams.sparkSession.sparkContext.broadcast((_packed(first), _packed(words.select("w", "t", "o"))))
        pairs = bigrams.select(*names[:3])
    else:
        pairs = bigrams.join(first, "u").join(words.select("w", F.col("t").alias("wt"), F.col("o").alias("wo")), "w").select(*names)

    def run(batches):
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if shared is not None and len(columns[0]):
                (u, *of_context), (w, *of_word) = shared.value
                if not len(u):
                    continue
                key = columns[0].view(np.uint64)
                begin = (key >> HALF).astype(np.uint32)
                at = np.minimum(np.searchsorted(u, begin), len(u) - 1)
                known = u[at] == begin
                columns = [c[known] for c in columns]
                of = np.searchsorted(w, columns[0].view(np.uint64).astype(np.uint32))  # every bigram's word is there
                columns += [c[at[known]].astype(np.int64) for c in of_context] + [c[of].astype(np.int64) for c in of_word]
            if len(columns[0]):
                quotients = _pair_quotients(*columns, t, o, left)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0]), pa.array(columns[1] + columns[2]), *(pa.array(x, from_pandas=True) for x in quotients)], names=["key", "n", *ratios]
                )

    ratios = [f"r{i}" for i in range(len(DISCOUNTS))]
    quotients = pairs.mapInArrow(run, "key long, n long, " + ", ".join(f"{r} double" for r in ratios))
    pairs = cut_lineage(quotients.where(" or ".join(f"{r} is not null" for r in ratios)).select("key", "n", *(F.ln(r).alias(r) for r in ratios)))
    if shared is not None:
        shared.destroy()
    return words.select(F.col("w").alias("key"), total.alias("n"), *(F.ln(word_share("t", i) / word_share("o", i)).alias(f"r{i}") for i in range(len(DISCOUNTS)))), pairs


def _sorted(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Key and ratio as arrays in the order of the keys."""
    key, ratio = _columns(table.select("key", F.col("ratio").cast("float").alias("ratio")))
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], ratio[order]


def _frequent(table: DataFrame, entries: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """The most frequent of key, n and ratio, up to ``entries`` by powers of two of n, and a table of the others."""
    power = F.floor(F.log2("n"))
    least, held, left = None, 0, 0
    for p, n in sorted(table.groupBy(power.alias("p")).count().collect(), reverse=True):
        if left or held + n > entries:
            left += n
        else:
            least, held = p, held + n
    split = F.lit(False) if least is None else power >= least
    return _sorted(table.where(split).select("key", "ratio")), table.where(~split).select("key", "ratio") if left else None


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", entries: int = ENTRIES) -> Model:
    """Models from all labelled rows outside the held-out fifth, and a curve from some of them.

    Three in ten rows, or of ``fit_rows`` where more have labels, fit the curve and choose the discount
    from ``DISCOUNTS``; they are chosen by a hash of their id. All other rows are counted. What reaches
    the driver is bounded: the words and bigrams of the curve's rows and a few numbers per row, and the
    ``entries`` most frequent words and bigrams. Rows without id, text or label teach nothing; without
    rows of both classes every score is the share of toxic rows.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    count = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    counted = draw < 1 - (1 - COUNT_SHARE) * min(1.0, fit_rows / max(count, 1))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    rows = lambda chosen: texts.join(_spread(known.where(chosen), count), "doc_id").select((F.col("toxic") == 1).alias("toxic"), "text")
    curve_rows = cut_lineage(rows(~counted))
    tables = _ratio_tables(cut_lineage(_counts(rows(counted))))
    empty = (np.zeros(0, dtype=np.uint64), np.zeros(0))
    blank = lambda w, p: Model(*w, *p, np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1))
    if tables is None:
        return _best([blank(empty, empty)], curve_rows)
    bigrams = _halves(cut_lineage(_counts(curve_rows)))
    wanted = [cut_lineage(bigrams.select(F.col(c).alias("key"))) for c in ("w", "key")]
    needed = [cut_lineage(matching(t, w, "key")) for t, w in zip(tables, wanted)]
    at = lambda t, i: t.where(f"r{i} is not null").select("key", "n", F.col(f"r{i}").alias("ratio"))
    models = [blank(*(_sorted(at(t, i).select("key", "ratio")) for t in needed)) for i in range(len(DISCOUNTS))]
    best = _best(models, curve_rows)
    (words, rare_words), (pairs, rare_pairs) = (_frequent(at(t, next(i for i, m in enumerate(models) if m is best)), entries) for t in tables)
    return Model(*words, *pairs, best.center, best.scale, best.curve, rare_words, rare_pairs)


def _best(models: list[Model], rows: DataFrame) -> Model:
    """The model whose logistic curve on the features of ``rows`` (toxic, text) fits their labels best."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = ["y", *(f"x{i}" for i in range(WIDTH * len(models)))]

    def run(batches):
        for batch in batches:
            x = [c for m in shared.value for c in features(m, batch.column(1)).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x)], names=names)

    y, *x = _columns(rows.mapInArrow(run, ", ".join(f"{n} {'boolean' if n == 'y' else 'double'}" for n in names)))
    y = y.astype(float)
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 0.499)
        models[0].curve[0] = np.log(share / (1 - share))
        return models[0]
    losses = [_fit_curve(m, np.column_stack(x[WIDTH * i:WIDTH * (i + 1)]), y) for i, m in enumerate(models)]
    return models[int(np.argmin(losses))]


def _fit_curve(model: Model, x: np.ndarray, y: np.ndarray) -> float:
    """Set the model's curve by logistic regression with a light penalty; returns the log loss."""
    model.center, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - model.center) / model.scale])
    curve = np.zeros(WIDTH + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -50, 50)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(WIDTH + 1)
        curve = curve - np.linalg.solve(hessian, z.T @ (p - y) + 0.3 * curve)
    model.curve = curve
    p = np.clip(probability(model, x), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _joined(texts: DataFrame, model: Model) -> DataFrame:
    """text_key and score of every distinct text of ``texts`` (text_key, text), with the model's rare entries."""
    shared = texts.sparkSession.sparkContext.broadcast(replace(model, rare_words=None, rare_pairs=None))
    any_words, any_pairs = model.rare_words is not None, model.rare_pairs is not None
    top = [f"e{i}" for i in range(TOP)]
    names = ["uid", "text_key", "words", "total", *top, "pair", "word", "known"]
    kinds = ["long", "long", "long", *["double"] * (1 + TOP), "long", "long", "double"]

    def run(batches):
        m = shared.value
        for batch in batches:
            done = 0
            for words, before, ends in _tokens(batch.column(2)):
                pair, n = _pair(before, words), np.diff(ends)
                nothing = np.full(len(words), np.nan)
                word_ratio = _lookup(m.words, m.word_ratio, words, nothing)
                ratio = _lookup(m.pairs, m.pair_ratio, pair, nothing)
                unsettled = np.isnan(ratio) & (any_pairs | (any_words & np.isnan(word_ratio)))
                ratio = np.nan_to_num(np.where(np.isnan(ratio), word_ratio, ratio))
                x = _summary(np.where(unsettled, 0.0, ratio), ends)
                ids = batch.slice(done, len(n))
                done += len(n)
                none = lambda size, kind: pa.nulls(size, kind)
                head = [ids.column(1), ids.column(0), pa.array(n), pa.array(x[:, 0] * np.maximum(n, 1)), *(pa.array(x[:, 2 + i].copy()) for i in range(TOP))]
                yield pa.RecordBatch.from_arrays([*head, none(len(n), pa.int64()), none(len(n), pa.int64()), none(len(n), pa.float64())], names=names)
                at = np.flatnonzero(unsettled)
                uid = ids.column(1).to_numpy()[np.searchsorted(ends, at, side="right") - 1]
                # a known word needs no lookup; its bigram's hash spreads such rows
                word = np.where(np.isnan(word_ratio[at]), words[at], pair[at])
                body = [pa.array(signed(pair[at])), pa.array(signed(word)), pa.array(word_ratio[at], from_pandas=True)]
                yield pa.RecordBatch.from_arrays([pa.array(uid), none(len(at), pa.int64()), none(len(at), pa.int64()), *[none(len(at), pa.float64())] * (1 + TOP), *body], names=names)

    numbered = texts.select("text_key", F.monotonically_increasing_id().alias("uid"), "text")
    lines = cut_lineage(numbered.mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds)))))
    tokens = lines.where("pair is not null").select("uid", "pair", "word", "known")
    for table, column, name in ((model.rare_pairs, "pair", "pr"), (model.rare_words, "word", "wr")):
        if table is None:
            tokens = tokens.withColumn(name, F.lit(None).cast("double"))
        else:
            tokens = tokens.join(table.withColumnsRenamed({"key": column, "ratio": name}), column, "left")
    ratio = F.coalesce("pr", "known", "wr", F.lit(0.0))
    largest = lambda x: F.slice(F.sort_array(x, asc=False), 1, TOP)
    more = tokens.select("uid", ratio.alias("r")).groupBy("uid").agg(F.sum("r").alias("more"), largest(F.collect_list(F.when(F.col("r") > EVIDENCE, F.col("r") - EVIDENCE))).alias("also"))
    rows = lines.where("pair is null").select("uid", "text_key", "words", "total", *top).join(more, "uid", "left")
    rows = rows.withColumn("also", largest(F.concat(F.array(*top), F.coalesce("also", F.array().cast("array<double>")))))
    x = [(F.col("total") + F.coalesce("more", F.lit(0.0))) / F.greatest("words", F.lit(1)), F.log1p("words"), *(F.col("also")[i] for i in range(TOP))]
    z = F.lit(float(model.curve[0]))
    for c, center, scale, weight in zip(x, model.center, model.scale, model.curve[1:]):
        z = z + (c - float(center)) / float(scale) * float(weight)
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))
    return cut_lineage(rows.select("text_key", p.alias("score")).groupBy("text_key").agg(F.min("score").alias("score")))


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Only the text decides; null, empty and wordless texts get the score of zero evidence. Repeated
    rows get equal scores; an id may be null. Other columns are ignored.
    """
    if model.rare_words is not None or model.rare_pairs is not None:
        found = _joined(docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).alias("text")), model)
        rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), _text_key(text_col).alias("text_key"))
        return rows.join(_spread(found, found.count()), "text_key").select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            p = probability(shared.value, features(shared.value, batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], names=["doc_id", "held_out", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    if model.rare_words is not None or model.rare_pairs is not None:
        found = _joined(docs.select(_text_key(text_col).alias("text_key"), F.col(text_col).alias("text")), model)
        key = "text_key of the model"
        toxic = found.where("score >= 0.5").select(F.col("text_key").alias(key))
        return matching(docs.withColumn(key, _text_key(text_col)), toxic, key, "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    position = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(probability(shared.value, features(shared.value, batch.column(position))) < 0.5))

    return docs.mapInArrow(run, docs.schema)
