import math
import random
import zlib
from collections import defaultdict

import pytest

from panelcast.llm import mixing, sharding
from tests.llm.helpers import AWKWARD, docs, sentence, words


def test_shards_are_even_and_gapless(spark):
    rnd = random.Random(5)
    rows = [(i, sentence(rnd, rnd.randint(1, 60))) for i in range(400)]
    rows += [(1000 + i, "the same text in a third of all rows") for i in range(250)] + AWKWARD
    for cell in (20_000, 40):
        got = sharding.shard(docs(spark, rows), shards=8, cell_rows=cell).collect()
        assert len(got) == len(rows)
        by_shard = defaultdict(list)
        for r in got:
            by_shard[r.shard].append(r)
        total, largest = sum(r.size for r in got), max(r.size for r in got)
        assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by_shard.values())
        assert all(abs(sum(r.size for r in g) - total / 8) <= largest for g in by_shard.values())
        assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)


def test_copies_are_cut_between_shards(spark):
    got = sharding.shard(docs(spark, [(i, "copy") for i in range(160)])).collect()
    assert sorted(r.shard for r in got) == [i // 10 for i in range(160)]
    assert [r.shard for r in sorted(got, key=lambda r: r.doc_id)] == [i // 10 for i in range(160)]


def test_few_and_no_rows(spark):
    assert sharding.shard(docs(spark, [])).count() == 0
    assert sharding.shard(docs(spark, [(1, None)])).first().slot == 0


def water(sizes, weights, total, most=3):
    target = dict.fromkeys(sizes, 0.0)
    open_ = set(sizes)
    rest = total
    while open_:
        whole = sum(weights[s] for s in open_)
        stop = {s for s in open_ if rest * weights[s] / whole >= most * sizes[s]}
        if not stop:
            for s in open_:
                target[s] = rest * weights[s] / whole
            break
        for s in stop:
            target[s] = most * sizes[s]
            rest -= most * sizes[s]
        open_ -= stop
    return target


def test_targets_and_taken_words(spark):
    rnd = random.Random(6)
    names = ["b", "a", None, "B", "é", "tiny"]
    rows = [(i, sentence(rnd, rnd.randint(0, 40)), names[0] if rnd.random() < 0.4 else rnd.choice(names[:5])) for i in range(900)]
    rows += [(2000, "one", "tiny"), (2001, None, "void"), (2002, "", "void")]
    got = mixing.mix_report(docs(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], 40)
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs(spark, rows).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mix_repeats_whole_rows(spark):
    rows = [(i, "a b c", "x" if i % 2 else "y") for i in range(60)] + [(100, None, "z")]
    table = docs(spark, rows)
    report = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix_report(table).collect()}
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    count = defaultdict(int)
    for r in mixed.collect():
        count[r.doc_id] += 1
    assert count == {i: n for i, n in report.items() if n}
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix_report(docs(spark, [])).count() == 0
    assert math.isclose(sum(count.values()) * 3, 180, rel_tol=0.1)
