import random

import numpy as np
import pyarrow as pa

from panelcast.llm import decontaminate as d
from tests.llm.helpers import AWKWARD, docs, sentence


def edited(rnd, text, share):
    s = list(text)
    for _ in range(int(len(s) * share)):
        at = rnd.randrange(len(s))
        kind = rnd.random()
        if kind < 0.4:
            s[at] = rnd.choice("klmnop")
        elif kind < 0.7:
            del s[at]
        else:
            s.insert(at, rnd.choice("klm "))
    return "".join(s)


def least_edits(pattern, text):
    """Fewest edits between ``pattern`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_windows_against_dynamic_programming():
    rnd = random.Random(2)
    items = [(i, sentence(rnd, 25)) for i in range(8)]
    index = d.build(items)
    texts = [sentence(rnd, 40) + " " + edited(rnd, items[i % 8][1], 0.01 * (i % 14)) + " " + sentence(rnd, 20) for i in range(28)] + [sentence(rnd, 200), "", None]
    got = {m[:2] for m in d._batch_matches(index, pa.array(texts))}
    want = set()
    for row, text in enumerate(texts):
        for w in range(len(index.starts)):
            pattern = index.text[index.starts[w]:index.starts[w] + index.lengths[w]].tobytes().decode()
            if text and least_edits(pattern, text) <= index.budgets[w]:
                want.add((row, int(index.items[w])))
    assert got == want and len(want) > 10


def least_edits_at_once(patterns, text):
    """As ``least_edits`` for a matrix of patterns of one length."""
    span = np.arange(len(text) + 1)
    row = np.zeros((len(patterns), len(text) + 1), dtype=np.int64)
    for i in range(patterns.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (patterns[:, i:i + 1] != text))
        row = np.minimum.accumulate(new - span, axis=1) + span
    return row.min(axis=1)


def test_passages_between_multiples_of_forty():
    rnd = random.Random(4)
    items = [(i, sentence(rnd, n)) for i, n in enumerate((60, 62, 90, 20, 17))]
    flat = [np.frombuffer(t.encode(), dtype=np.uint8) for _, t in items]
    index = d.build(items)
    texts = [items[0][1][20:100], "zzz " + items[0][1][20:100] + " zzz"]
    for i in range(60):
        source = items[i % 5][1]
        at = rnd.randrange(max(1, len(source) - 79))
        texts.append("w" * rnd.randint(0, 9) + edited(rnd, source[at:at + rnd.randint(76, 110)], 0.02 * (i % 7)) + "v" * rnd.randint(0, 90))
    got = {m[:2]: m[2:4] for m in d._batch_matches(index, pa.array(texts))}
    want = {}
    for row, text in enumerate(texts):
        even, _, _ = d.plain(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))
        for item, t in enumerate(flat):
            m = min(80, len(t))
            edits = least_edits_at_once(np.lib.stride_tricks.sliding_window_view(t, m), even)
            if edits.min() <= m // 10:
                want[row, item] = (int((edits <= m // 10).sum()), int(edits.min()))
    assert got == want and {(0, 0), (1, 0)} < set(got) and 20 < len(want)


def test_case_punctuation_and_blocks(spark):
    rnd = random.Random(3)
    items = spark.createDataFrame([(i, sentence(rnd, 20), "c") for i in range(12)] + [(20, None, "c"), (None, "lost item without any id", "c"), (21, "tiny", "c")], "item_id long, text string, doc_id string")
    text = {r.item_id: r.text for r in items.collect()}
    rows = [(1, f"Start. {text[3].upper().replace(' ', ', ')}! End"), (2, sentence(rnd, 60)), (3, text[0] + " and " + text[5]), (3, text[0] + " and " + text[5]), (4, "tiny"), *AWKWARD[6:]]
    for block in (10**6, 300):
        got = sorted((r.doc_id, r.item_id) for r in d.contaminated(docs(spark, rows), items, block_bytes=block).collect())
        assert got == [(1, 3), (3, 0), (3, 0), (3, 5), (3, 5)]
        clean = d.decontaminate(docs(spark, rows), items, block_bytes=block)
        assert clean.columns == docs(spark, []).columns
        assert clean.count() == len(rows) - 3


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(docs(spark, AWKWARD), items).count() == 0
    assert d.decontaminate(docs(spark, AWKWARD), items).count() == len(AWKWARD)
    assert d.contaminated(docs(spark, []), spark.createDataFrame([(1, "some words that make up an item")], items.schema)).count() == 0
