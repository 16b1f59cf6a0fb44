import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from panelcast.llm import merkle
from panelcast.llm.merkle import document_manifest, leaf, manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, tree string, at string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(row):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(show(row[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))


def climb(nodes, i):
    """Top, siblings of node i level by level, and the runs a digest in its place is folded with."""
    around, folds = [], []
    while len(nodes) > 1:
        run = nodes[i - i % 3:i - i % 3 + 3]
        around += run[:i % 3] + run[i % 3 + 1:]
        folds.append((run[:i % 3], run[i % 3 + 1:]))
        nodes, i = [sha("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)], i // 3
    return nodes[0], around, folds


def brute(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, row_digest(r))) for s in sources}
    subroots = [climb([row_digest(r) for r in trees[s]], 0)[0] for s in sources]
    out = []
    for k, s in enumerate(sources):
        digests = [row_digest(r) for r in trees[s]]
        root, above, upper = climb(subroots, k)
        for i, r in enumerate(trees[s]):
            _, below, lower = climb(digests, i)
            crc = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode())
            node = row_digest({**r, "text": r["text"].replace("\n", "")} if crc % 2 == 0 and r["text"] is not None else r)
            for left, right in lower + upper:
                node = sha("".join([*left, node, *right]))
            out.append((r["doc_id"], digests[i], subroots[k], root, sha("".join(below + above)), node, node == root))
    return sorted(out, key=str)


def check(spark, rows, levels=merkle.LEVELS):
    table = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "a", "b", "c", "d") for r in rows], SCHEMA)
    got = document_manifest(table, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def make(i, source, text="x\ny"):
    return {"doc_id": i, "text": text, "lang": None if i and i % 5 == 0 else "de", "source": source, "n_chars": None if text is None else len(text)}


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_trees_by_brute_force(spark, levels):
    rnd = random.Random(2)
    rows = [make(i, "hot", rnd.choice(["a\nb", "plain", None, ""])) for i in range(200)]
    rows += [make(1000 + i, f"s{i % 13}") for i in range(40)] + [make(2000, None), make(2001, ""), make(2002, "é"), make(2003, "\U0001F600")]
    rows += [make(None, "hot", "no id"), make(None, None, "neither"), make(7, "hot", "again"), make(7, "hot", "again")]
    check(spark, rows, levels)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes(spark, n):
    check(spark, [make(i, "one") for i in range(n)])


def test_sources_of_one_row(spark):
    check(spark, [make(i, f"s{i}") for i in range(11)])


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert document_manifest(empty).collect() == []


def test_long_text_and_bytes(spark):
    check(spark, [make(1, "a", "é" * 200_000 + "\n"), make(2, "a", "\U0001F600\n\n")])


def test_many_equal_rows_spread_over_tasks(spark):
    """Rows alike in every column are numbered from several tasks."""
    same = spark.range(20_000).select(F.lit(1).alias("k"), F.lit("s").alias("g"))
    got = merkle.numbered(same.repartition(4), ["g"], ["k"])
    assert [r[0] for r in got.select("_pos").orderBy("_pos").collect()] == list(range(20_000))
    assert got.select("_n").distinct().collect()[0][0] == 20_000


def test_changed_digests_are_found(spark):
    table = spark.createDataFrame([(i, "s", "t") for i in range(50)], "id int, source string, text string")
    fields = [F.col("id"), F.col("text")]
    now = leaf([F.col("id"), F.when(F.col("id") == 17, "other").otherwise(F.col("text"))])
    got = manifest(table, fields, F.col("source"), F.col("id"), now)
    assert [r.key for r in got.where("not verified").collect()] == [17]
