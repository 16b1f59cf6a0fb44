"""Raw CSV tables.

A gzip file cannot be split, so each one is read by one task; rows are spread right after
the scan. Convert once with ``to_parquet`` and read that from then on: filters and
column pruning then reach the scan.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.reference import SOURCE_FILES
from panelcast.sources.schemas import SCHEMAS

FILE_OF = {table: (name, required) for table, name, required in SOURCE_FILES}
SPREAD_BY = {"dengue": ["geocode", "date"], "climate": ["geocode", "date"], "climate_forecast": ["geocode"]}


def _cast(c: str, t: T.DataType) -> Column:
    """Dirty text becomes NULL rather than an error; whole numbers may carry a fraction."""
    if isinstance(t, (T.IntegerType, T.LongType)):
        return F.col(c).try_cast("double").cast(t)
    if isinstance(t, T.DoubleType):
        return F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    if isinstance(t, T.DateType):
        return F.substring(c, 1, 10).try_cast("date")
    return F.col(c).try_cast(t)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One raw table by name. Optional tables whose file is absent come back empty.

    Columns are matched by header name; known ones are cast, others stay text.
    """
    name, required = FILE_OF[table]
    schema = T._parse_datatype_string(SCHEMAS[table])
    try:
        raw = spark.read.csv(f"{folder.rstrip('/')}/{name}", header=True)
    except AnalysisException as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    types = {f.name: f.dataType for f in schema.fields}
    df = raw.select(*[(_cast(c, types[c]) if c in types else F.col(c)).alias(c) for c in raw.columns])
    if table == "dengue":
        df = df.withColumn("casos", F.coalesce("casos", F.lit(0).cast("bigint")))
    return df.repartition(*SPREAD_BY[table]) if table in SPREAD_BY else df


def scan_dengue(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "dengue")


def scan_climate(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "climate")


def scan_climate_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "climate_forecast")


def scan_population(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "population")


def scan_environ(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "environ")


def scan_ocean(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "ocean")


def scan_regional_map(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "regional_map")


def to_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def source_inventory(spark: SparkSession, folder: str, expected: list[tuple] = SOURCE_FILES) -> DataFrame:
    """Every expected file with whether it is there and its size. Contents are not read."""
    wanted = spark.createDataFrame(expected, "table string, file string, required boolean")
    found = (
        spark.read.format("binaryFile")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    )
    return wanted.join(found, "file", "left").select(
        "table", "file", "required", F.col("bytes").isNotNull().alias("present"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )
