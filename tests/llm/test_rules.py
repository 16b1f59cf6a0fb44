import random
import re

import numpy as np
import pyarrow as pa

from panelcast.llm import rules
from tests.llm.helpers import AWKWARD, docs, sentence


def plain(text):
    """The statistics of one text, written from their names."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x]
    size = lambda s: len(s.encode())
    share = [sum(text.count(c) for c in members) / max(len(text), 1) for members in rules.CLASSES.values()]
    n = max(len(words), 1)
    return [
        *share, np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), len(set(words)) / n, len(set(lines)) / max(len(lines), 1),
        sum(map(size, words)) / n, np.log1p(max(map(size, words), default=0)), sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


def test_statistics_by_hand():
    texts = [t for _, t in AWKWARD] + ["a a b\n\na a b\nÉé é#1!", "\n\n", "x\ny\nx"]
    got = rules.measure(pa.array(texts))
    assert np.allclose(got, [plain(t) for t in texts])
    assert rules.measure(pa.array([], pa.string())).shape == (0, len(rules.NAMES))


def corpus(n=900):
    rnd = random.Random(8)
    good = [sentence(rnd, rnd.randint(20, 80)) + "." for _ in range(n)]
    bad = [(t.upper() if i % 3 == 0 else " ".join(t.split()[:2] * 20) if i % 3 == 1 else t.replace(" ", "### ")) for i, t in enumerate(good)]
    return [(i, b if i % 4 == 0 else g, "s") for i, (g, b) in enumerate(zip(good, bad))], {i: int(i % 4 != 0) for i in range(n)}


def test_held_out_rows(spark):
    rows, quality = corpus()
    table = docs(spark, rows + [(None, None), (5000, ""), (5000, None), (5001, "x" * 100_000)])
    labels = spark.createDataFrame([*quality.items(), (None, 1), (3, None)], "doc_id long, quality int")
    model = rules.fit(table, labels)
    assert model.rules and all(1 <= len(r.terms) <= 2 * rules.DEPTH for r in model.rules)
    got = rules.score(table, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    assert len(held) > 200 and sum(r.predicted == quality[r.doc_id] for r in held) / len(held) > 0.97
    assert len({r.score for r in got if r.doc_id == 5000}) == 1
    kept = rules.keep_good(table, model)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, quality = corpus(400)
    table = docs(spark, rows)
    held = {r.doc_id for r in rules.score(table, rules.Model(0.0, ())).where("held_out").collect()}
    one = rules.fit(table, spark.createDataFrame(list(quality.items()), "doc_id long, quality int"))
    two = rules.fit(table, spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in quality.items()], "doc_id long, quality int"))
    assert one == two


def test_few_or_no_labels(spark):
    table = docs(spark, [(1, "a b"), (2, None), (None, "c")])
    for labels in ([], [(1, 1)], [(1, 1), (2, 1)], [(9, 0)]):
        model = rules.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert model.rules == () and rules.score(table, model).count() == 3
    assert rules.score(docs(spark, []), rules.Model(0.0, ())).collect() == []


def test_expression_equals_arrays(spark):
    rows, quality = corpus(300)
    x = rules.measure(pa.array([t for _, t, _ in rows]))
    y = np.array([quality[i] for i, _, _ in rows], dtype=float)
    model = rules.weigh(x, y, rules.grow(x, y))
    z = model.intercept + sum(r.weight * r.holds(x) for r in model.rules)
    got = {r.doc_id: r.score for r in rules.score(docs(spark, rows), model).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], 1 / (1 + np.exp(-z)))


def test_penalised_weights_are_a_minimum():
    rng = np.random.default_rng(1)
    z = np.column_stack([np.ones(400), rng.normal(size=(400, 6))])
    y = (rng.random(400) < 1 / (1 + np.exp(-(z @ [0.3, 1, -1, 0, 0, 0, 0])))).astype(float)
    beta = rules.lasso(z, y, 0.05, np.zeros(7), rounds=3000)
    slope = z.T @ (1 / (1 + np.exp(-(z @ beta))) - y) / 400
    assert abs(slope[0]) < 1e-6
    for b, s in zip(beta[1:], slope[1:]):
        assert abs(s + 0.05 * np.sign(b)) < 1e-6 if b else abs(s) <= 0.05 + 1e-6
    assert (beta[3:] == 0).any()
