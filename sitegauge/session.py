"""Session helpers: settings for local runs, checkpoint and scratch folders, input spreading."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sitegauge")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent a local session uses a folder in its warehouse; any other
    session must name one, as its executors share no disk with the driver.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark)}/sitegauge/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows as a table below the shared folder and read them back.

    Like a reliable checkpoint it survives lost executors; being columnar with known size, it
    also lets later joins prune columns and pick their strategy.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of whatever store Spark reads; none if it does not exist."""
    files, where = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


# More parts than this bring nothing to an input that fits a few splits.
MOST_SPREAD = 200


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Repartition a raw scan by key, only when it has fewer splits than there are cores.

    Large inputs have many more splits than cores and pass through unchanged, so no
    shuffle of raw text is added at scale; a single small file is spread out before
    CPU-heavy expressions.
    """
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, MOST_SPREAD)
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *[F.col(k) if isinstance(k, str) else k for k in keys])
