import random
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from panelcast.llm import catalog
from panelcast.session import scratch_path
from tests.llm.helpers import docs, sentence, shingles


def test_names():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_stages_on_a_small_corpus(spark):
    rnd = random.Random(14)
    folder = scratch_path(spark, "corpus")
    benchmark = [(i, sentence(rnd, 22)) for i in range(4)]
    rows = [(i, sentence(rnd, rnd.randint(20, 60)), f"s{i % 3}") for i in range(300)]
    toxic = {i for i in range(300) if i % 6 == 0}
    rows = [(i, t + " vile nasty rotten", s) if i in toxic else (i, t, s) for i, t, s in rows]
    leaked = {7, 13}
    rows = [(i, t + " " + benchmark[0][1], s) if i in leaked else (i, t, s) for i, t, s in rows]
    copies = [(500 + i, rows[20 + i][1], "s1") for i in range(10) if 20 + i not in toxic]
    docs(spark, rows + copies).select("doc_id", "text", "source").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, folder)
        if name != "sharding":
            assert out.columns == table.columns
        path = scratch_path(spark, name)
        out.write.parquet(path)
        table = spark.read.parquet(path)
        kept[name] = [r.doc_id for r in table.collect()]
    left = {i for i, _, _ in rows + copies} - toxic
    assert set(kept["toxicity"]) == left
    left -= {i for i, _, _ in copies}
    assert sorted(kept["near_duplicates"]) == sorted(left)
    left -= leaked
    assert sorted(kept["decontamination"]) == sorted(left)
    assert set(kept["mixing"]) <= left and max(Counter(kept["mixing"]).values()) <= 3
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(kept["sharding"])


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, "x"), (None, "x")]
    table = docs(spark, rows)
    got = corpus_pipeline.drop_near_duplicates(spark, table, "")
    assert got.columns == table.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None", "None"]
    assert shingles(rows[0][1], 5)


def test_unrelated_texts_under_one_id_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "A b c  d e f g"), (1, "quite another text that shares nothing"), (2, "one more here"), (2, None), (2, "")]
    table = docs(spark, rows)
    got = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, table, "").collect())
    assert got == [(1, "A b c  d e f g"), (1, "quite another text that shares nothing"), (2, ""), (2, "one more here")]
