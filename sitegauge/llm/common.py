"""Helpers that the operators of this folder share."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitegauge.session import cut_lineage

SPACES = b" \t\n\v\f\r"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that a lost executor costs one read of it."""
    return cut_lineage(df, name)


def worker_cache(name: str, make: Callable[[], object]):
    """A value kept for the life of a Python worker; tasks that follow on the same worker reuse it."""
    store = sys.modules.setdefault("_sitegauge_worker", ModuleType("_sitegauge_worker"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def without_collector(run: Callable) -> Callable:
    """``run`` with no search for cycles while its caches fill; when a task ends, what it left goes back, as workers are reused."""

    def quiet(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()

    return quiet


def word_chunks(raw: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists of bounded size, so that a huge text needs little memory."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end] not in SPACES:
            end += 1
        yield raw[at:end].split()
        at = end


def extended(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` with more fields."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(fields).fields])


def map_batches(df: DataFrame, schema, each: Callable[[pa.RecordBatch], list | None]) -> DataFrame:
    """Apply a function from Arrow batch to columns; it must be a plain per-batch function."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    while wanted in df.columns:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a scan; reading the same files again gives the same numbers."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
