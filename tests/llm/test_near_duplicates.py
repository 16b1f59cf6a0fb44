import random

import numpy as np
import pyarrow as pa
import pytest

from panelcast.llm import minhash
from panelcast.llm.components import connected_components
from tests.llm.helpers import AWKWARD, components, docs, sentence, shingles


def brute(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return components(sets, links), {i: len(s) for i, s in sets.items()}


def family(rnd, start, n, edits):
    """Copies of one text with up to ``edits`` words changed."""
    base = sentence(rnd, 120).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = sentence(rnd, 1)
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, words, percent):
    rnd = random.Random(4)
    common = sentence(rnd, 14)
    rows = [(i, sentence(rnd, rnd.randint(1, 80))) for i in range(100)]
    # a common line in most texts, a family with more members than a short list, copies
    rows += [(100 + i, common + "\n" + sentence(rnd, rnd.randint(1, 60))) for i in range(80)]
    rows += family(rnd, 200, 70, 7) + family(rnd, 300, 10, 3)
    rows += [(400 + i, rows[i * 3][1]) for i in range(50)]
    rnd.shuffle(rows)
    want, sizes = brute(rows, words, percent)
    got = minhash.near_duplicates(docs(spark, rows), words=words, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_are_bounded_by_rows_too(spark):
    """A large family of short texts that do not link but for a few, in blocks of few rows."""
    rows = [(i, f"one line that all have {i}") for i in range(90)] + [(100 + i, f"one line that all have {i} {i}") for i in range(4)]
    base = docs(spark, rows)
    shared = {i: shingles(t, 3) for i, t in rows}
    entries = spark.createDataFrame([(7, i, len(shared[i]), i, 0) for i in shared], "value long, node long, n int, part long, main long")
    want = {tuple(sorted((a, b))) for a in shared for b in shared if a != b and 100 * len(shared[a] & shared[b]) >= 75 * len(shared[a] | shared[b])}
    assert want
    for block_rows in (7, 2048):
        got = minhash._block_links(entries, base.select("doc_id", "text"), 3, 75, block_rows=block_rows).collect()
        assert {tuple(sorted((r.a, r.b))) for r in got} == want


def test_members_of_long_lists_are_computed_once(spark):
    """Ids, loads and both sides of the blocks share one computation of the members."""
    rows = [(i, f"one line that all have {i}") for i in range(60)] + [(100 + i, f"one line that all have {i} {i}") for i in range(4)]
    shared = {i: shingles(t, 3) for i, t in rows}
    entries = spark.createDataFrame([(7, i, len(shared[i]), i, 0) for i in shared], "value long, node long, n int, part long, main long")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = minhash._block_links(entries.mapInArrow(counted, entries.schema), docs(spark, rows).select("doc_id", "text"), 3, 75, block_rows=7).collect()
    want = {tuple(sorted((a, b))) for a in shared for b in shared if a != b and 100 * len(shared[a] & shared[b]) >= 75 * len(shared[a] | shared[b])}
    assert {tuple(sorted((r.a, r.b))) for r in got} == want
    assert read.value == len(rows)


def test_values_needed_outside_long_lists():
    assert (minhash._enough(16, 85), minhash._enough(16, 80), minhash._enough(16, 50)) == (10, 12, 16)


def test_awkward_rows(spark):
    got = minhash.near_duplicates(docs(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and all(by_id[i].kept for i in (1, 2, 3))
    assert by_id[5].component_id == 4 and by_id[7].n_shingles == 1 and by_id[8].n_shingles == 1
    assert all(r.component_id is None and not r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.near_duplicates(docs(spark, [(1, None)])).first().component_id == 1


def test_sets_equal_plain_python():
    texts = ["A b c d", "a B  c", "x", None, "", "a b c a b c a b c", "ä Ä é"]
    got = [len(s) for s in minhash.shingle_sets(pa.array(texts), 3)]
    assert got == [len(shingles(t, 3)) for t in texts]
    one, two = minhash.shingle_sets(pa.array(["Q W E R", "q w e r"]), 3)
    assert np.array_equal(one, two)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(70)]
    want = components({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 5)], "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
