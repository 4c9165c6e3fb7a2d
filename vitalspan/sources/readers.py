"""Scans: delimited text, many files, tables, lookups, feature lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.functions.scalars import extract


def read_typed(
    spark: SparkSession, path, schema: T.StructType | str, null_token: str = "NULL", sep: str = "\t",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Delimited text with declared types. Columns not listed are skipped by the scan."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, nullValue=null_token, positiveInf="Inf")
    return df.select(*columns) if columns else df


def read_raw(spark: SparkSession, path, columns: Sequence[str], sep: str = "\t", null_token: str = "") -> DataFrame:
    """Every column as text; parse later with ``try_cast``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, sep=sep, header=True, nullValue=null_token)


def read_inferred(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """Inferred types cost one more pass over the text; meant for exploration, not for large inputs."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def read_many(
    spark: SparkSession, path, schema: T.StructType | str, name_regex: str, name: str = "name", sep: str = "\t"
) -> DataFrame:
    """Many files as one scan, with a column taken from each file's path."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=True)
    return df.withColumn(name, extract(F.col("_metadata.file_path"), name_regex, 1))


def read_table(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """Columnar table; later filters and selections reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_database(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Database table read in ``partitions`` key ranges; filters are pushed into the database."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions
    )
    return reader.options(**(options or {})).load()


def read_feature_list(spark: SparkSession, path) -> DataFrame:
    """One feature name per line, split into group, name and the ``/``-joined values."""
    parts = F.split("value", "_")
    rows = spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("fgroup"), F.get(parts, F.lit(1)).alias("fname"), F.get(parts, F.lit(2)).alias("fvalue")
    )
    return rows.distinct()


def read_bands(spark: SparkSession, path) -> DataFrame:
    """Probability bands: from, to (the last one may be ``Inf``), probability."""
    return read_typed(spark, path, "`from` DOUBLE, `to` DOUBLE, probability DOUBLE", sep=",")


def header_columns(spark: SparkSession, path, sep: str = "\t") -> list[str]:
    """Column names of a delimited file, from its first line only."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, samplingRatio=None).columns
