"""From raw documents to shards: five stages, each of which reads what the one before wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir). All but the last return rows of
``docs`` with their columns; the last returns where each row goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import decontaminate, minhash, mixing, sharding, toxicity
from panelcast.llm.common import WORD, matching, read
from panelcast.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from the labels of ``docs``, is below one half."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 similar sets of five-word shingles: the one with the
    smallest id. Of rows that repeat an id and their words one stays, the first by its columns; rows of one
    id with other words stay, as do documents without words and rows without id."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    rest = matching(docs, found.where("doc_id is not null and not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = cut_lineage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    if repeated.isEmpty():
        return rest
    lower = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    alike = F.md5(F.concat_ws(" ", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    twice = matching(rest, repeated, "doc_id").select(F.col("doc_id").alias("_id"), alike.alias("_words"), row.alias("_row"))
    once = twice.groupBy("_id", "_words").agg(F.min("_row").alias("_row")).select("_row.*")
    return matching(rest, repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources' words come near their targets."""
    return mixing.mix(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, by equal bytes."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

# scores of fitted models are not for SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
