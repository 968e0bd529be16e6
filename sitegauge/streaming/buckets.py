"""A table kept current batch by batch: rows in buckets by key, of which a batch rewrites those that it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import folder_names, remove_folder

FIRST_BUCKETS = 8
BUCKET_ROWS = 1_000_000
INDEX = "buckets int, bucket int, version long, rows long"


class BucketedTable:
    """The rows of ``path`` by ``key``, in as many buckets as keep them near ``bucket_rows`` rows each.

    ``merge`` reads and writes the buckets of the batch's keys only, one folder each: what a batch costs
    depends on its keys, not on the batches before it. When rows have outgrown the buckets, one batch
    rewrites them all into twice as many. A batch writes its own folders, then an index that names the
    folder of each bucket; readers follow the newest index, so a batch that failed half-way is not seen
    and may be repeated. Folders that two indexes no longer name are removed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.key, self.schema, self.bucket_rows = spark, path, key, schema, bucket_rows

    def _batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in folder_names(self.spark, f"{self.path}/index") if n.startswith("batch="))

    def _index(self, batch_id: int) -> list:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index/batch={batch_id}").collect()

    def _place(self, bucket: int, version: int) -> str:
        return f"{self.path}/rows/batch={version}/bucket={bucket}"

    def _rows(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def current(self, buckets: set[int] | None = None, batch_id: int | None = None) -> DataFrame:
        """The newest rows, or those that a batch left; of some buckets, or of all."""
        batches = [b for b in self._batches() if batch_id is None or b <= batch_id]
        index = self._index(batches[-1]) if batches else []
        return self._rows([self._place(r.bucket, r.version) for r in index if r.rows and (buckets is None or r.bucket in buckets)])

    def merge(self, batch_id: int, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> set[int]:
        """Replace the touched buckets' rows by ``combine(their rows, rows)``; returns the buckets."""
        past = [b for b in self._batches() if b < batch_id]
        index = self._index(past[-1]) if past else []
        before = index[0].buckets if index else FIRST_BUCKETS
        buckets = before
        while sum(r.rows for r in index) > buckets * self.bucket_rows:
            buckets *= 2
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(buckets)).cast("int")
        touched = {r[0] for r in rows.select(bucket).distinct().collect()} if buckets == before else set(range(buckets))
        there = [self._place(r.bucket, r.version) for r in index if r.rows and (r.bucket in touched or buckets != before)]
        merged = combine(self._rows(there), rows).select(*self.schema.names).withColumn("bucket", bucket)
        folder = f"{self.path}/rows/batch={batch_id}"
        merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        own = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
        counts = {r.bucket: r["count"] for r in own.groupBy("bucket").count().collect()}
        kept = [(buckets, r.bucket, r.version, r.rows) for r in index if r.bucket not in touched and buckets == before]
        new = kept + [(buckets, b, batch_id, counts.get(b, 0)) for b in sorted(touched)]
        self.spark.createDataFrame(new, INDEX).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/batch={batch_id}")
        if len(past) > 1:
            named = {(r.bucket, r.version) for r in index} | {(b, v) for _, b, v, _ in new}
            for r in self._index(past[-2]):
                if (r.bucket, r.version) not in named:
                    remove_folder(self.spark, self._place(r.bucket, r.version))
            remove_folder(self.spark, f"{self.path}/index/batch={past[-2]}")
        return touched
