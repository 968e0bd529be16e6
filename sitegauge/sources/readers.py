"""Readers. Every schema is declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

CORRUPT = "_corrupt_record"


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType = schemas.PAGE_TEXT) -> DataFrame:
    """Lines that do not parse are skipped, missing string fields become ``""``.

    Adds ``seq``: unique and increasing along each file, to carry the line order.
    """
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return parse_json_lines(lines, "value", schema, ["seq"])


def parse_json_lines(lines: DataFrame, column: str, schema: T.StructType, keep: list[str]) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.select(*keep, F.col(column).alias("_line"), F.from_json(column, wide, options).alias("_r"))
    good = parsed.filter(
        (F.trim("_line") != "") & F.col("_r").isNotNull() & F.col(f"_r.{CORRUPT}").isNull()
    )
    fields = [
        F.coalesce(F.col(f"_r.{f.name}"), F.lit("")).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f"_r.{f.name}").alias(f.name)
        for f in schema.fields
    ]
    return good.select(*keep, *fields)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType = schemas.PAGE_TEXT) -> DataFrame:
    """Blank lines are skipped; a line that does not parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv_strings(spark: SparkSession, path: str, schema: T.StructType = schemas.COMPANY, multi_line: bool = True) -> DataFrame:
    """Header CSV with all columns as strings; an empty field is ``""``.

    ``multi_line=False`` is for files whose fields hold no line breaks: large files are then split over tasks.
    """
    rows = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return rows.na.fill("")


def read_chunks_csv(spark: SparkSession, path: str, schema: T.StructType = schemas.CHUNK, multi_line: bool = True) -> DataFrame:
    """The chunk table: all fields quoted, backslash escapes, line breaks inside fields.

    ``multi_line=False`` is for tables without line breaks, whose files can be split.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", "\\")
        .option("multiLine", multi_line)
        .csv(path)
    )


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """``name, revenue`` from ``{"data": [{name, value}]}`` or a bare ``[{name, value}]``."""
    either = T.StructType([*schemas.RANKING_ENVELOPE.fields, *schemas.RANKING_ITEM.fields])
    docs = spark.read.schema(either).option("multiLine", True).json(path)
    return unwrap_ranking(docs)


def unwrap_ranking(docs: DataFrame) -> DataFrame:
    bare = F.array(F.struct("name", "value"))
    items = docs.select(F.explode(F.coalesce(F.col("data"), bare)).alias("item"))
    return items.select(F.col("item.name").alias("name"), F.col("item.value").alias("revenue"))


def read_saved_ranking(spark: SparkSession, path: str) -> DataFrame:
    """The ranking as saved: an array of ``{name, revenue}``."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("revenue", T.DoubleType())])
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages: ``page_id, url, html``."""
    return read_parquet(spark, path, schemas.PAGES)


def read_crawls(spark: SparkSession, path: str) -> DataFrame:
    """Crawl results, one JSON object per line or file."""
    return spark.read.schema(schemas.CRAWL_RESULT).option("multiLine", True).json(path)


def read_label_maps(spark: SparkSession, path: str) -> DataFrame:
    """``kind, label, id`` rows of a label-map document."""
    doc = spark.read.schema(schemas.LABEL_MAPS).option("multiLine", True).json(path)
    kinds = [
        F.struct(F.lit(f.name).alias("kind"), F.col(f.name).alias("ids")) for f in schemas.LABEL_MAPS.fields
    ]
    return doc.select(F.explode(F.array(*kinds)).alias("m")).select(
        F.col("m.kind").alias("kind"), F.explode("m.ids").alias("label", "id")
    )
