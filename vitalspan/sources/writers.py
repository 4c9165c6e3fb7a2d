"""Sinks: appended tables, new keyed tables, delimited exports, wide prediction files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.operators.validate import require_valid
from vitalspan.session import settle


def append_table(df: DataFrame, path: str, rules: Sequence[dict] = (), parents: dict[str, DataFrame] | None = None,
                 partition_by: Sequence[str] = ()) -> None:
    """Append rows to a columnar table after its rules hold, its primary key also against the rows already there.

    The rows are written to the shared folder first, so that what is validated is what is appended.
    """
    rows = settle(df)
    if rules:
        require_valid(rows, rules, parents or {})
    keys = [list(r["columns"]) for r in rules if r["rule"] == "primary_key"]
    if keys and table_exists(df.sparkSession, path):
        old = df.sparkSession.read.parquet(path)
        for key in keys:
            if not rows.join(old.select(*key), key, "left_semi").isEmpty():
                raise ValueError(f"primary key {', '.join(key)} is already in the table at {path}")
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at ``path``, in any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def create_table(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Write a new table whose ``key`` must be unique; a table that is there already is an error."""
    rows = settle(df)
    require_valid(rows, [{"rule": "primary_key", "columns": list(key)}], {})
    rows.write.mode("errorifexists").parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", null_token: str = "NULL", compression: str = "none") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue=null_token, compression=compression)


def wide_predictions(df: DataFrame, breaks: Sequence[float], value: str = "surv", keys: Sequence[str] = ("pid",)) -> DataFrame:
    """One row per patient, one column per break. The break list is given, so no extra pass finds it.

    One aggregation by patient: a pivot would first keep a row a patient and break in memory.
    """
    cells = [F.first(F.when(F.col("time") == F.lit(float(b)), F.col(value)), True).alias(f"{float(b):g}") for b in breaks]
    return df.groupBy(*keys).agg(*cells)


def long_predictions(wide: DataFrame, keys: Sequence[str] = ("pid",), value: str = "surv") -> DataFrame:
    """Inverse of :func:`wide_predictions`: numeric column names become the time column."""
    cols = [F.col(f"`{c}`") for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), cols, "time", value).withColumn("time", F.col("time").cast("double"))
