"""Quality from a sparse ensemble of rules over statistics of a text.

Shallow trees are boosted on a bounded sample of labelled rows. Every path from a root to one of its
nodes is a rule, a conjunction of comparisons. A logistic regression with an absolute penalty weighs the
rules and drops most of them, and what is left is compiled into Spark expressions over columns of
statistics, which tasks compute from the bytes of whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import SEPARATOR, mix, powers, text_slices
from panelcast.session import cut_lineage

# labelled rows that fit the model; the score of a text depends on more only through the fit
FIT_ROWS = 20_000
FOLDS, HELD = 3, 1
TREES = 40
DEPTH = 3
STEP = 0.3
CUTS = 32
LEAST = 8
PENALTIES = (0.1, 0.03, 0.01, 0.003, 0.001)
ROUNDS = 150

# characters whose shares in a text count
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digits": "0123456789",
    "stops": ".,;:",
    "marks": "!?",
    "symbols": "#$%&*@^~=+<>|{}[]\\_/",
    "spaces": " \t\n\x0b\x0c\r",
}
NAMES = [*CLASSES, "length", "words", "lines", "distinct_words", "distinct_lines", "word_length", "longest_word", "stutter"]


def held_out(doc_id: Column) -> Column:
    """Whether a row's label must not be learned from: a third of ids, by checksum."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def _runs(data: np.ndarray, offsets: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length and row of every run of bytes that are not marked in ``between``, within rows."""
    inside = ~between[data]
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    starts[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    stops[tails] = inside[tails]
    at, end = np.flatnonzero(starts), np.flatnonzero(stops)
    if len(at) == 0:
        return np.zeros(0, dtype=np.uint64), at, at
    up, down = powers(len(data))
    values = (data.astype(np.uint64) + np.uint64(1)) * inside * up
    return mix(np.add.reduceat(values, at) * down[at]), end - at + 1, np.searchsorted(offsets, at, side="right") - 1


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Different hashes per row, by 43 of their bits beside the number of the row in its slice."""
    keys = np.sort((row.astype(np.uint64) << np.uint64(43)) | (hashes >> np.uint64(21)))
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, dtype=bool)
    return np.bincount((keys[first] >> np.uint64(43)).astype(np.int64), minlength=n)


def measure(column: pa.Array) -> np.ndarray:
    """The statistics ``NAMES`` of every text of a column, one row each; a null is an empty text.

    Shares refer to characters. Words and lines are compared byte by byte.
    """
    line = np.zeros(256, dtype=bool)
    line[10] = True
    out = [np.zeros((0, len(NAMES)))]
    for _, data, offsets in text_slices(column):
        n = len(offsets) - 1
        per_row = lambda marked: np.diff(np.r_[0, np.cumsum(marked[data], dtype=np.int64)][offsets])  # noqa: B023, E731
        table = np.zeros(256, dtype=bool)
        table[:0x80] = table[0xC0:] = True
        chars = per_row(table)
        x = np.zeros((n, len(NAMES)))
        for i, members in enumerate(CLASSES.values()):
            table = np.zeros(256, dtype=bool)
            table[np.frombuffer(members.encode(), dtype=np.uint8)] = True
            x[:, i] = per_row(table) / np.maximum(chars, 1)
        words, size, row = _runs(data, offsets, SEPARATOR)
        lines, _, of_line = _runs(data, offsets, line)
        n_words, n_lines = np.bincount(row, minlength=n), np.bincount(of_line, minlength=n)
        longest = np.zeros(n)
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            longest[row[first]] = np.maximum.reduceat(size, first)
        equal = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        more = {
            "length": np.log1p(chars),
            "words": np.log1p(n_words),
            "lines": np.log1p(n_lines),
            "distinct_words": _distinct(words, row, n) / np.maximum(n_words, 1),
            "distinct_lines": _distinct(lines, of_line, n) / np.maximum(n_lines, 1),
            "word_length": np.bincount(row, weights=size, minlength=n) / np.maximum(n_words, 1),
            "longest_word": np.log1p(longest),
            # of words that are equal to the one before
            "stutter": np.bincount(row[1:], weights=equal, minlength=n) / np.maximum(n_words, 1),
        }
        x[:, len(CLASSES):] = np.column_stack(list(more.values()))
        out.append(x)
    return np.concatenate(out)


def statistics(df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with a column per statistic (``_s0``, ..), and without the text unless it is to be kept."""
    position = df.columns.index(text_col)
    kept = [f for i, f in enumerate(df.schema.fields) if keep_text or i != position]
    schema = T.StructType([*kept, *(T.StructField(f"_s{i}", T.DoubleType()) for i in range(len(NAMES)))])

    def run(batches):
        for batch in batches:
            x = measure(batch.column(position))
            rest = [c for i, c in enumerate(batch.columns) if keep_text or i != position]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, cut), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, cut in self.terms:
            out &= (x[:, f] > cut) == above
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, cut in self.terms:
            out &= F.col(f"_s{f}") > cut if above else F.col(f"_s{f}") <= cut
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]

    def describe(self) -> list[tuple[str, float]]:
        """Rules in words, with their weights, the heaviest first."""
        say = lambda r: " and ".join(f"{NAMES[f]} {'>' if above else '<='} {cut:.4g}" for f, above, cut in r.terms)
        return sorted(((say(r), r.weight) for r in self.rules), key=lambda p: -abs(p[1]))


def _tidy(terms: list[tuple[int, bool, float]]) -> tuple:
    """The terms without those that another one of the same statistic and direction implies."""
    tight: dict[tuple[int, bool], float] = {}
    for f, above, cut in terms:
        old = tight.get((f, above), cut)
        tight[f, above] = max(old, cut) if above else min(old, cut)
    return tuple(sorted((f, above, cut) for (f, above), cut in tight.items()))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Rules of ``trees`` boosted trees: each is grown on the gradient that those before it left."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    rules: dict[tuple, Rule] = {}
    logit = np.full(len(y), np.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / np.clip(1 - y.mean(), 1e-3, 1)))
    rng = np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-6)
        # other rows and statistics in every tree make other rules
        rows = rng.random(len(y)) < 0.7
        tried = rng.permutation(x.shape[1])[:max(3, 2 * x.shape[1] // 3)]
        nodes = [(np.arange(len(y)), [])]
        for level in range(depth + 1):
            following = []
            for members, terms in nodes:
                used = members[rows[members]]
                split = None if level == depth else _best_split(bins, cuts, used, gradient, hessian, tried)
                if split is None:
                    logit[members] += STEP * gradient[used].sum() / (hessian[used].sum() + 1.0)
                    continue
                f, b = split
                for above in (False, True):
                    branch = [*terms, (f, above, float(cuts[f][b]))]
                    key = _tidy(branch)
                    rules.setdefault(key, Rule(key))
                    following.append((members[(bins[members, f] > b) == above], branch))
            nodes = following
    return list(rules.values())


def _best_split(bins, cuts, rows, gradient, hessian, tried) -> tuple[int, int] | None:
    best, found = 1e-6, None
    g, h = gradient[rows], hessian[rows]
    for f in tried:
        if len(cuts[f]) == 0 or len(rows) < 2 * LEAST:
            continue
        size = len(cuts[f]) + 1
        b = bins[rows, f]
        n = np.cumsum(np.bincount(b, minlength=size))[:-1]
        gl = np.cumsum(np.bincount(b, weights=g, minlength=size))[:-1]
        hl = np.cumsum(np.bincount(b, weights=h, minlength=size))[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, found = gain[at], (int(f), at)
    return found


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Intercept and weights that minimise the mean log loss plus ``penalty`` times the sum of the
    weights' absolute values, by accelerated proximal gradient steps. ``z`` starts with a column of ones."""
    v = np.ones(z.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / max(float(v @ (z.T @ (z @ v))), 1e-9) / 1.02
    beta, ahead, t = start.copy(), start.copy(), 1.0
    shrink = np.r_[0.0, np.full(z.shape[1] - 1, penalty * rate)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead, -50, 50)))
        new = ahead - rate * (z.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - shrink, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - beta)
        beta, t = new, after
    return beta


def _loss(z: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    m = np.clip(z @ beta, -50, 50)
    return np.logaddexp(0, m) - y * m


def weigh(x: np.ndarray, y: np.ndarray, rules: list[Rule]) -> Model:
    """The rules that a penalised logistic regression keeps. The penalty is the largest one whose loss on
    a third of the rows is within one standard error of the best; all rows fit the result."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    held = np.random.default_rng(11).random(len(y)) < 1 / 3
    flat = Model(float(np.log(share / (1 - share))), ())
    if not rules or min(y.sum(), len(y) - y.sum()) < 2 or y[~held].min() == y[~held].max() or not held.any():
        return flat
    holds = np.column_stack([r.holds(x) for r in rules]).astype(float)
    mean = holds.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    z = np.column_stack([np.ones(len(y)), (holds - mean) / scale])
    beta, losses = np.zeros(z.shape[1]), []
    for penalty in PENALTIES:
        beta = lasso(z[~held], y[~held], penalty, beta)
        losses.append(_loss(z[held], y[held], beta))
    best = int(np.argmin([v.mean() for v in losses]))
    allowed = losses[best].mean() + losses[best].std() / np.sqrt(held.sum())
    chosen = next(p for p, v in zip(PENALTIES, losses) if v.mean() <= allowed)
    beta = np.zeros(z.shape[1])
    for penalty in [p for p in PENALTIES if p >= chosen]:
        beta = lasso(z, y, penalty, beta)
    weights = beta[1:] / scale
    kept = tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights) if w != 0)
    return Model(float(beta[0] - (weights * mean).sum()), kept)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, held: Column | None = None) -> Model:
    """Rules and weights from at most ``fit_rows`` labelled rows outside the held-out third.

    The rows are those with the smallest hashes of id and text. Rows without id or label teach nothing; a
    null text is an empty one. Without two rows of either class every score is the share of good rows.
    Repeated ids and labels count as often as they occur. Other columns of ``docs`` are ignored.
    """
    out = held_out(F.col("doc_id")) if held is None else held
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~out)
    # ids of small hashes first, so that no more of them than a task may hold is sent along
    chosen = cut_lineage(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit_rows))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    order = F.xxhash64("doc_id", "text")
    rows = cut_lineage(rows.select("label", order.alias("_at"), "text"))
    columns = [f"_s{i}" for i in range(len(NAMES))]
    table = statistics(rows).orderBy("_at", "label").limit(fit_rows).toArrow()
    y = table.column("label").to_numpy().astype(float)
    x = np.column_stack([table.column(c).to_numpy() for c in columns]) if len(y) else np.zeros((0, len(NAMES)))
    return weigh(x, y, grow(x, y) if len(y) and y.min() < y.max() else [])


def probability(model: Model) -> Column:
    """The model as an expression over the columns of ``statistics``."""
    z = F.lit(model.intercept)
    for rule in model.rules:
        z = z + F.when(rule.column(), F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; see ``fit``.

    Only the whole text decides; null and empty texts score as texts without characters. Repeated rows
    get equal scores; an id may be null. Other columns are ignored.
    """
    seen = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    scored = seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), probability(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score one half or more, with all their columns."""
    # under names of its own, since a column may be called like a statistic
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    seen = statistics(own, f"c{docs.columns.index(text_col)}", keep_text=True)
    return seen.where(probability(model) >= 0.5).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
