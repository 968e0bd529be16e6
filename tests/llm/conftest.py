import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with more columns if asked for."""

    def make(pairs, parts=3, **more):
        rows = [(i, t, "en", None, None if t is None else len(t), *more.values()) for i, t in pairs]
        schema = T.StructType([*DOCS.fields, *[T.StructField(n, T.StringType()) for n in more]])
        return spark.createDataFrame(rows, schema).repartition(parts, "doc_id") if rows else spark.createDataFrame([], schema)

    return make
