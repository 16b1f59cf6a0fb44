"""Written results and the feature cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.groups import attach

FILE_ROWS = 1_000_000


def by_folder(df: DataFrame, by: tuple[str, ...], file_rows: int = FILE_ROWS) -> DataFrame:
    """Rows dealt so that a folder is written by as many tasks as it has ``file_rows``, from exact counts.

    Reads ``df`` twice; write an expensive one first. Rows alike in all columns stay together.
    """
    rest = [c for c in df.columns if c not in by]
    files = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / file_rows).alias("_files"))
    dealt = attach(df, files, list(by), rest).withColumn("_s", F.pmod(F.xxhash64(*rest), F.col("_files")))
    return dealt.repartition(*by, "_s").select(*df.columns)


def write_forecasts(df: DataFrame, path: str, fmt: str = "csv", by: tuple[str, ...] = ("uf", "model"), file_rows: int = FILE_ROWS) -> None:
    """One folder per series and model, so that reading some of them skips the rest; a large folder
    gets a file per ``file_rows`` rows or so."""
    out = by_folder(df, by, file_rows).write.mode("overwrite").partitionBy(*by)
    out.option("header", True).format(fmt).save(path)


def read_forecasts(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def save_ensemble(path: str, forecasts: DataFrame, weights: DataFrame, corrections: DataFrame) -> None:
    for name, table in (("forecasts", forecasts), ("weights", weights), ("corrections", corrections)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_ensemble(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("forecasts", "weights", "corrections")}


SCORES = (
    "crps double, wis_total double, rmse double, mae double, mape double, bias double, "
    "coverage_50 double, coverage_80 double, coverage_90 double, coverage_95 double"
)
RESULT_SCHEMA = (
    "state string, timestamp string, validation_tests map<string, struct<test_number: string, "
    f"state: string, status: string, metrics: map<string, struct<{SCORES.replace(' double', ': double')}>>>>, "
    "top_models array<struct<model_name: string, combined_score: double>>, uf string"
)


def validation_documents(metrics: DataFrame, top: DataFrame | None = None, timestamp: str | None = None) -> DataFrame:
    """One nested document per state: test -> model -> scores, and the selected models."""
    names = [c.split()[0] for c in SCORES.split(", ")]
    scores = F.struct(*[F.col(n).cast("double").alias(n) for n in names])
    tests = metrics.groupBy("uf", "test").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", scores)))).alias("m")
    )
    entry = F.struct(
        F.col("test").alias("test_number"), F.col("uf").alias("state"), F.lit("success").alias("status"), F.col("m").alias("metrics")
    )
    states = tests.groupBy("uf").agg(F.map_from_entries(F.collect_list(F.struct("test", entry))).alias("validation_tests"))
    if top is not None:
        ranked = top.groupBy("uf").agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("rank", F.col("model").alias("model_name"), "combined_score"))),
                lambda r: F.struct(r["model_name"].alias("model_name"), r["combined_score"].alias("combined_score")),
            ).alias("top_models")
        )
        states = states.join(ranked, "uf", "left")
    else:
        states = states.withColumn("top_models", F.lit(None).cast("array<struct<model_name: string, combined_score: double>>"))
    when = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    return states.select(F.col("uf").alias("state"), when.alias("timestamp"), "validation_tests", "top_models", "uf")


def write_validation(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy("uf").json(path)


def read_validation(spark: SparkSession, path: str) -> DataFrame:
    """Back to one row per state, test and model."""
    docs = spark.read.schema(RESULT_SCHEMA).json(path)
    tests = docs.select("state", F.explode("validation_tests").alias("test", "t"))
    models = tests.select(F.col("state").alias("uf"), "test", F.explode("t.metrics").alias("model", "s"))
    return models.select("uf", "test", "model", "s.*")


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("header", True).csv(path)


def save_knowledge(path: str, results: DataFrame, best: DataFrame) -> None:
    results.write.mode("overwrite").parquet(f"{path}/results")
    best.write.mode("overwrite").parquet(f"{path}/best")


def load_knowledge(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/results"), spark.read.parquet(f"{path}/best")


def write_submissions(documents: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per state (``BR`` for the nation): documents as JSON, or rows as CSV."""
    from panelcast.plans.submission import to_rows

    if fmt == "json":
        keyed = documents.withColumn("folder", F.coalesce("adm_1", F.lit("BR")))
        keyed.write.mode("overwrite").partitionBy("folder").option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        rows = to_rows(documents).withColumn("folder", F.col("adm_1"))
        by_folder(rows, ("folder",)).write.mode("overwrite").partitionBy("folder").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def data_key(df: DataFrame) -> DataFrame:
    """Order-independent fingerprint of all rows: one row ``n, h``. Both parts are sums,
    so they combine map-side."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("h"))


def cache_key(df: DataFrame, config: dict) -> str:
    """Key of a computed table: fingerprint of its input and of its configuration."""
    k = data_key(df).first()
    text = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(f"{k.n}:{k.h}:{sorted(df.columns)}:{text}".encode()).hexdigest()[:32]


class FeatureCache:
    """Parquet tables below ``root``, one folder ``key=<key>`` per computed table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/key={key}"

    def _file(self, path: str):
        """The file system and path object of ``path``, local or remote."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def get(self, key: str) -> DataFrame | None:
        """A table counts once its commit marker is there."""
        files, marker = self._file(f"{self.path(key)}/_SUCCESS")
        return self.spark.read.parquet(self.path(key)) if files.exists(marker) else None

    def set(self, key: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(key))

    def get_or_compute(
        self, df: DataFrame, compute: Callable[[DataFrame], DataFrame], config: dict, use_cache: bool = True
    ) -> DataFrame:
        key = cache_key(df, config)
        if not use_cache:
            return df.transform(compute)
        if (hit := self.get(key)) is not None:
            return hit
        self.set(key, df.transform(compute))
        return self.spark.read.parquet(self.path(key))

    def info(self) -> DataFrame:
        """Files and bytes of every cached table."""
        files = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load(self.root)
            .select("path", "length")
        )
        return files.groupBy(F.regexp_extract("path", "key=([^/]+)", 1).alias("key")).agg(
            F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
        )

    def clear(self, key: str) -> None:
        files, target = self._file(self.path(key))
        files.delete(target, True)
