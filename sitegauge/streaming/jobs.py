"""Structured Streaming: continuous company scores and restartable feature building."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import folder_names
from .buckets import BUCKET_ROWS, BucketedTable


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream with a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def _others(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``old`` whose key ``new`` does not have; null is a key."""
    keys = new.select(F.col(key).alias("_key")).distinct()
    return old.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")


def _upsert(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: _others(old, new, key).unionByName(new)


def start_scores(
    pages: DataFrame, company: str, probs: str, n_classes: int, out: str, checkpoint: str,
    trigger: dict | None = None, bucket_rows: int = BUCKET_ROWS,
) -> StreamingQuery:
    """Running mean probabilities per company, kept as one current row per company below ``out``.

    The state holds one sum and count per class and company; the changed rows of a batch replace
    those of their companies. A repeated batch gives the same table.
    """
    running = pages.groupBy(company).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.array(*[F.avg(F.get(F.col(probs), F.lit(i))) for i in range(n_classes)]).alias(probs),
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            BucketedTable(batch.sparkSession, out, company, batch.schema, bucket_rows).merge(batch_id, rows, _upsert(company))
        finally:
            rows.unpersist()

    writer = running.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _stored(spark: SparkSession, path: str, key: str) -> DataFrame:
    newest = max(folder_names(spark, f"{path}/rows"), key=lambda n: int(n.split("=")[1]))
    schema = spark.read.parquet(f"{path}/rows/{newest}").drop("bucket").schema
    return BucketedTable(spark, path, key, schema).current()


def latest_scores(spark: SparkSession, out: str, company: str) -> DataFrame:
    """One row per company, as of the last batch."""
    return _stored(spark, out, company)


def start_features(
    records: DataFrame,
    key: str,
    build: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    distinct: bool = False,
    trigger: dict | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> StreamingQuery:
    """Features per key that do not depend on how the records fall into batches.

    Every batch adds its records to the stored ones and builds the features of the keys it touches
    from all their records, so a late record updates its key. With ``distinct`` one record of each
    key counts, however late the others come. Records and features are kept by key in buckets, of
    which a batch reads and rewrites those of its own keys.
    """

    def add(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new)
        return both.dropDuplicates([key]) if distinct else both

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch.persist()
        try:
            kept = BucketedTable(spark, f"{out}/records", key, batch.schema, bucket_rows)
            touched = kept.merge(batch_id, rows, add)
            keys = rows.select(F.col(key).alias("_key")).distinct()
            stored = kept.current(touched, batch_id)
            features = build(stored.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")).persist()
            try:
                BucketedTable(spark, f"{out}/features", key, features.schema, bucket_rows).merge(batch_id, features, _upsert(key))
            finally:
                features.unpersist()
        finally:
            rows.unpersist()

    writer = records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_features(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The newest features of every key."""
    return _stored(spark, f"{out}/features", key)
