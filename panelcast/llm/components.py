"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """Node and the smallest node of its component, for every node with an edge.

    ``edges`` has columns ``a`` and ``b``; order, repeats and loops do not matter. Large-star and
    small-star steps alternate until the edges are stars around each component's smallest node. Each
    step is a minimum per node and a join, so no node's neighbours are gathered, and each round is
    written to the shared folder. Rows with a null end and an empty list give no rows.
    """
    stars = cut_lineage(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        count = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if count == seen or count["n"] == 0:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = count
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        stars = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
