"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. Around digits, ``@`` and written-out at-signs the text is cut into tokens,
and every run of at most ``LONGEST`` tokens is a candidate segment for each kind. Features of the whole
span - its digit groups, separators, checks, length and surroundings - score it, and dynamic programming
over segments of bounded length chooses boundaries and kinds jointly. The field is trained here, by the
gradient of its likelihood, on base spans of a bounded sample and on variations of them that the
patterns miss. Its spans that overlap no base span are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST = 15
LEAST_DIGITS = 7
FIT_ROWS = 2_000
FIT_ISLANDS = 1_500
FIT_TOKENS = 40
ROUNDS = 8

# the contract's patterns; look-behinds and possessive runs only spare attempts that cannot match
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]+|[\[(](?:at|AT)[\])]")
TOKEN = re.compile(r"\w+|[^\w\s]")
AT_WORD = re.compile(r"\s*[\[(](?:at|AT)[\])]\s*")
DIGIT_GROUP = re.compile(r"[0-9]+")
ADDRESS = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(groups: list[str]) -> bool:
    return all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in groups)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by its pattern, leftmost and without overlap within the kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out["email"].append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not DIGIT_GROUP.search(text):
        return out
    out["ip"] = [m.span() for m in IP.finditer(text) if _octets(m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGIT_GROUP.findall(m[0]))) <= 15]
    return out


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches of neighbouring chunks between white space that hold a trigger; two chunks more on each
    side of a written-out at-sign."""
    out: list[tuple[int, int]] = []
    for m in TRIGGER.finditer(text):
        low = out[-1][1] if out else 0
        if m.start() < low:
            continue
        extra = 2 if m[0][0] in "[(" else 0
        start, end = m.span()
        while start > low and not (text[start - 1].isspace() and not extra):
            start -= 1
            if text[start].isspace() and (start == 0 or not text[start - 1].isspace()):
                extra -= 1
        extra = 3 if m[0][0] in "[(" else 0
        while end < len(text) and not (text[end].isspace() and not extra):
            extra -= text[end].isspace() and extra > 0
            end += 1
        if out and not text[low:start].strip():
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """Candidate runs of tokens, first and behind last, that could be an entity, with their features.

    A run with an at-sign can only be an email address, one of four groups of digits without letters
    anything else, and other runs a card or phone number.
    """
    digits = [0]
    signs = [0]
    for a, b in tokens:
        piece = text[a:b]
        digits.append(digits[-1] + sum(map(len, DIGIT_GROUP.findall(piece))))
        signs.append(signs[-1] + (piece == "@" or piece in ("at", "AT")))
    out = []
    n = len(tokens)
    for i in range(n):
        head = text[tokens[i][0]]
        if not (head.isalnum() or head in "+("):
            continue
        for j in range(i + 1, min(n, i + LONGEST) + 1):
            if signs[j] == signs[i] and not LEAST_DIGITS <= digits[j] - digits[i] <= 20:
                if digits[j] - digits[i] > 20:
                    break
                continue
            if text[tokens[j - 1][1] - 1].isalnum():
                out.append((i, j, _features(text, tokens[i][0], tokens[j - 1][1])))
    return out


def _features(text: str, start: int, end: int) -> list[str]:
    span = text[start:end]
    groups = DIGIT_GROUP.findall(span)
    count = sum(map(len, groups))
    rest = DIGIT_GROUP.sub("", span)
    before = text[start - 1] if start else " "
    after = text[end] if end < len(text) else " "
    plain = AT_WORD.sub("@", span)
    word = re.findall(r"[^\W\d_]+", text[max(0, start - 20):start])
    touching = ("w" if before.isalnum() else "s" if before.isspace() else before if before in "+-.@=(" else "p") + ("w" if after.isalnum() else "s" if after.isspace() else after if after in "-.@" else "p")
    out = [
        "bias",
        f"digits:{min(count, 20)}",
        f"groups:{'-'.join(str(len(g)) for g in groups[:6]) if len(groups) <= 6 else 'many'}",
        f"between:{''.join(sorted(set(rest)))[:6] if not any(c.isalpha() for c in rest) else 'letters'}",
        f"touch:{touching}",
        f"spaces:{min(sum(c.isspace() for c in span), 4)}",
        f"word:{word[-1].lower() if word else ''}" if word and word[-1].lower() in CONTEXT else "word:other",
    ]
    if span[0] == "+":
        out.append("plus")
    if ADDRESS.fullmatch(plain):
        out.append(f"address:{plain is not span and plain != span}")
    elif "@" in plain:
        out.append("part of an address")
    if len(groups) == 4 and set(rest) == {"."} and len(rest) == 3:
        out.append(f"octets:{_octets(groups)}")
    if 13 <= count <= 19 and not any(c.isalpha() for c in rest):
        out.append(f"luhn:{luhn(''.join(groups))}:{count >= 16}")
    if rest.count("(") != rest.count(")"):
        out.append("open bracket")
    return out


# words ahead of a span that may announce it
CONTEXT = frozenset(["account", "call", "card", "cell", "contact", "credit", "email", "fax", "ip", "mail", "mobile", "phone", "tel", "telephone", "visa", "whatsapp"])


def _kinds(feats: list[str]) -> tuple[int, ...]:
    if any("address" in f for f in feats):
        return (0,)
    return (1, 2, 3) if any(f.startswith("octets") for f in feats) else (2, 3)


def _scores(weights: dict, feats: list[str]) -> list[tuple[int, float]]:
    """Score of the span for each kind it can be."""
    return [(k, sum(weights.get((k, f), 0.0) for f in feats)) for k in _kinds(feats)]


def best_path(weights: dict, n: int, candidates: list[tuple[int, int, list[str]]]) -> list[tuple[int, int, int]]:
    """(first, behind last, kind) of the segments on the best path over ``n`` tokens; other tokens score 0."""
    ending = defaultdict(list)
    for i, j, feats in candidates:
        k, s = max(_scores(weights, feats), key=lambda pair: pair[1])
        if s > 0:
            ending[j].append((i, k, s))
    score, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        score[j] = score[j - 1]
        for i, k, s in ending[j]:
            if score[i] + s > score[j]:
                score[j], back[j] = score[i] + s, (i, k)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x))


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = ROUNDS) -> dict:
    """Weights by stochastic gradient steps on the likelihood; ``examples`` are texts with (start, end, kind)."""
    prepared = []
    for text, gold in examples:
        tokens = tokens_of(text, 0, len(text))
        starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
        wanted = {(starts.get(a), ends.get(b), k) for a, b, k in gold}
        if len(tokens) > FIT_TOKENS or any(i is None or j is None for i, j, _ in wanted):
            continue
        prepared.append((len(tokens), segments(text, tokens), wanted))
    weights: dict = defaultdict(float)
    for round_ in range(rounds):
        rate = 0.3 / (1 + round_)
        for n, candidates, wanted in prepared:
            ending, starting = defaultdict(list), defaultdict(list)
            for c in candidates:
                s = _scores(weights, c[2])
                ending[c[1]].append((c, s))
                starting[c[0]].append((c, s))
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                total = alpha[j - 1]
                for (i, _, _), scores in ending[j]:
                    for _, s in scores:
                        total = _add(total, alpha[i] + s)
                alpha[j] = total
            for i in range(n - 1, -1, -1):
                total = beta[i + 1]
                for (_, j, _), scores in starting[i]:
                    for _, s in scores:
                        total = _add(total, beta[j] + s)
                beta[i] = total
            for j in range(1, n + 1):
                for (i, _, feats), scores in ending[j]:
                    for k, s in scores:
                        gap = ((i, j, k) in wanted) - math.exp(alpha[i] + s + beta[j] - alpha[n])
                        if abs(gap) > 1e-3:
                            for f in feats:
                                weights[k, f] += rate * gap
    return dict(weights)


def variations(text: str, gold: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The example, and for one with a single entity, forms of it that the patterns miss, and in its
    place strings of digits that are none: dates, plain numbers, card numbers with a wrong check digit."""
    out = [(text, gold)]
    if len(gold) != 1:
        return out
    (a, b, k), span = gold[0], text[gold[0][0]:gold[0][1]]
    forms, others = [], []
    digits = "".join(DIGIT_GROUP.findall(span)).ljust(8, "7")
    if KINDS[k] == "email":
        forms = [span.replace("@", " [at] "), span.replace("@", "(at)"), span.replace("@", " @ ")]
    elif KINDS[k] == "phone":
        forms = ["00" + span[1:], span[1:].partition(" ")[2] or span[1:]]
        others = [f"20{digits[:2]}-0{1 + int(digits[2]) % 9}-1{digits[3]}", digits, f"{digits[:2]}/{digits[2:4]}/20{digits[4:6]}"]
    elif KINDS[k] == "card" and len(span) == 16:
        forms = [c.join(span[i:i + 4] for i in range(0, 16, 4)) for c in (".", "/")]
        others = [span[:-1] + str((int(span[-1]) + 1) % 10), span[:9], span[:12]]
    else:
        others = [".".join(g[:2] for g in DIGIT_GROUP.findall(span)[:3]), digits[:8]]
    return out + [(text[:a] + f + text[b:], [(a, a + len(f), k)]) for f in forms if f] + [(text[:a] + f + text[b:], []) for f in others]


def _examples(text: str):
    spans = [(a, b, k) for k, kind in enumerate(KINDS) for a, b in base_spans(text)[kind]]
    for start, end in islands(text):
        start, end = max(0, start - 24), min(len(text), end + 4)
        inside = [(a - start, b - start, k) for a, b, k in spans if start <= a and b <= end]
        if any(a < end and b > start and not (start <= a and b <= end) for a, b, _ in spans):
            continue
        ordered = sorted(inside)
        if all(x[1] <= y[0] for x, y in zip(ordered, ordered[1:])):
            yield text[start:end], ordered


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, fit_islands: int = FIT_ISLANDS) -> dict:
    """Weights trained on up to ``fit_islands`` stretches from about ``fit_rows`` documents that have triggers.

    Both bounds are of the sample that the field learns from; what it finds is looked for in all texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    total = max(rows.count(), 1)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, fit_rows / total)))

    def run(batches):
        for batch in batches:
            found = [e for text in batch.column(1).to_pylist() for e in _examples(text)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in found], pa.string()), pa.array([[v for span in g for v in span] for _, g in found], pa.list_(pa.int64()))], names=["text", "gold"]
            )

    drawn = drawn.mapInArrow(run, "text string, gold array<long>").distinct().orderBy(F.xxhash64("text"), "text").limit(fit_islands)
    examples = []
    for r in drawn.collect():
        g = r["gold"]
        examples += variations(r["text"], [tuple(g[i:i + 3]) for i in range(0, len(g), 3)])
    return train(examples)


def find(text: str, weights: dict) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and added spans of a text, by kind."""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    added: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for start, end in islands(text) if weights else ():
        tokens = tokens_of(text, start, end)
        candidates = segments(text, tokens)
        if not candidates:
            continue
        for i, j, k in best_path(weights, len(tokens), candidates):
            a, b = tokens[i][0], tokens[j - 1][1]
            if not any(x < b and a < y for x, y in taken):
                added[KINDS[k]].append((a, b))
    return base, added


def _digest(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def personal_data(docs: DataFrame, weights: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and the number of added ones, for every row.

    Spans count code points, end exclusive. Null and empty texts have none. Repeated rows give equal
    results; ids may be null. Other columns of ``docs`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for batch in batches:
            numbers, hashes, joined, extra = [], [], [], []
            for text in batch.column(1):
                base, added = find(text.as_py() or "", shared.value)
                numbers.append([len(base[k]) for k in KINDS])
                hashes.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                joined.append(_digest({k: base[k] + added[k] for k in KINDS}))
                extra.append(sum(map(len, added.values())))
            columns = [pa.array([n[i] for n in numbers], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(hashes, pa.string()), pa.array(joined, pa.string()), pa.array(extra, pa.int64())], names=["doc_id", *counts, "base_sha256", "spans", "n_added"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {', '.join(c + ' long' for c in counts)}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, weights: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with every span found replaced by its kind in angle brackets; nulls stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    position = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, added = find(text, shared.value)
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k in KINDS for a, b in base[k] + added[k]):
            if a >= at:
                out += [text[at:a], f"<{k}>"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            yield batch.set_column(position, batch.schema.field(position), pa.array([clean(t.as_py()) for t in batch.column(position)], batch.schema.field(position).type))

    return docs.mapInArrow(run, docs.schema)
