"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "vitalspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``conf`` overrides them. Cluster sizes are left to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which every executor must reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder.rstrip("/")


def settle(df: DataFrame, compression: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where an expensive input feeds several branches of one plan. The written table survives lost
    executors, carries real sizes for the join planner and keeps column pruning. Rows of several MB each need
    ``group_rows``: a task holds the rows of a row group as it writes and as it reads, otherwise those of a whole file.
    """
    path = f"{run_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    groups = {} if group_rows is None else {"parquet.block.row.count.limit": str(group_rows)}
    df.write.options(compression=compression, **groups).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions in here send Python workers batches of at most so many rows, for rows of several MB each.

    Otherwise a task gathers as many of its rows as a batch may have outside the heap, and its worker as many again.
    """
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


_RUN = "spark.vitalspan.runFolder"


def run_folder(spark: SparkSession) -> str:
    """The folder of this session's settled tables inside the shared one."""
    own = spark.conf.get(_RUN, None)
    if not own or not own.startswith(shared_folder(spark)):
        own = f"{shared_folder(spark)}/vitalspan-{uuid.uuid4().hex}"
        spark.conf.set(_RUN, own)
    return own


def release(spark: SparkSession) -> None:
    """Removes the settled tables of this session. Frames that still read one of them can no longer be used."""
    place = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    spark.conf.unset(_RUN)
