import numpy as np
import pytest

from panelcast.llm import multi_index
from tests.llm.helpers import components

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, 1, "k") for i, v, c in rows], SCHEMA)


def brute(rows, cosine):
    good = [(i, np.array(v, dtype=np.float32).astype(float), c) for i, v, c in rows if i is not None and v is not None and c is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    links = set()
    for a, (i, x, c) in enumerate(good):
        for j, y, d in good[:a]:
            if c == d and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links |= {(i, j), (j, i)}
    return components({i for i, _, _ in rows if i is not None}, links), {i: sum(a == i for a, _ in links) for i, _, _ in rows}


@pytest.mark.parametrize("cell_rows,block", [(1000, 2048), (8, 16)])
def test_against_brute_force(spark, cell_rows, block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16), int(rng.integers(0, 3))) for i in range(150)]
    base = rng.normal(size=16)
    # near copies around the limit, exact copies, scaled ones
    rows += [(200 + i, base + rng.normal(size=16) * 0.12 * rng.random(), 1) for i in range(60)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(30)] + [(400 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(500, rows[0][1] * 1e20, rows[0][2]), (501, rows[0][1] * 1e-20, rows[0][2])]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] + [1.0] * 15, 1), (604, rows[0][1], None), (605, [float("inf")] * 16, 1), (606, [1.0, 2.0], 1), (607, [], 1)]
    want, links = brute([r for r in rows if r[0] < 606], 0.98)
    got = {r.vec_id: r for r in multi_index.near_duplicates(table(spark, rows), cell_rows=cell_rows, block=block).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].component_id for i in want} == want
    assert {i: got[i].n_links for i in links} == links
    assert all(got[i].n_links == 0 and got[i].kept for i in (606, 607))


@pytest.mark.parametrize("cell_rows,block", [(1000, 2048), (8, 16)])
def test_every_width_is_searched(spark, cell_rows, block):
    rng = np.random.default_rng(8)
    rows = []
    for start, width, n in ((0, 16, 60), (1000, 7, 50), (2000, 3, 40), (3000, 1, 12), (4000, 5, 2)):
        base = rng.normal(size=width)
        rows += [(start + i, base + rng.normal(size=width) * 0.3 * rng.random(), i % 2) for i in range(n)]
        rows += [(start + 500 + i, rows[-1 - i][1], rows[-1 - i][2]) for i in range(2)]
    got = {r.vec_id: r for r in multi_index.near_duplicates(table(spark, rows), cell_rows=cell_rows, block=block).collect()}
    assert len(got) == len(rows)
    for start in range(0, 5000, 1000):
        part = [r for r in rows if start <= r[0] < start + 1000]
        want, links = brute(part, 0.98)
        assert {i: got[i].component_id for i in want} == want
        assert {i: got[i].n_links for i in links} == links


def test_no_usable_rows(spark):
    assert multi_index.near_duplicates(table(spark, [])).count() == 0
    got = multi_index.near_duplicates(table(spark, [(1, None, 1), (None, [1.0], 1), (2, [0.0], 1)])).collect()
    assert {r.vec_id: r.component_id for r in got} == {1: 1, 2: 2, None: None}
    assert [r.kept for r in got if r.vec_id is None] == [False]


def test_bound_never_exceeds_the_distance():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6))
    books = multi_index.fit_codebooks(x, 5)
    nearest, low = multi_index._bounds(x[:, :3], books[0], multi_index._apart(books[0]))
    for i in range(0, 200, 7):
        for j in range(200):
            assert low[i, nearest[j]] <= np.linalg.norm(x[i, :3] - x[j, :3]) + 1e-9


def test_multi_sequence_is_in_order():
    cells = multi_index.multi_sequence(np.array([0.0, 3.0, 1.0]), np.array([0.0, 0.5]), 2.0)
    assert cells == [(0, 0), (0, 1), (2, 0), (2, 1)]
