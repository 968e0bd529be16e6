"""Company list: class buckets, registry lookups, resume sets, label encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import BAD_URLS, NO_URL, REVENUE_FLOORS, REVENUE_REST, literal_map, revenue_class
from .ranking import keep_first


def with_revenue_class(
    ranking: DataFrame,
    name: str = "name",
    revenue: str = "revenue",
    floors=REVENUE_FLOORS,
    rest: str = REVENUE_REST,
) -> DataFrame:
    """Rows with a name and a revenue, plus ``revenue_class``."""
    usable = ranking.filter((F.col(name) != "") & F.col(revenue).isNotNull())
    return usable.withColumn("revenue_class", revenue_class(F.col(revenue), floors, rest))


def url_or_sentinel(url: Column) -> Column:
    bad = url.isNull() | (url == "") | url.isin(*BAD_URLS)
    return F.when(bad, F.lit(NO_URL)).otherwise(url)


def crawlable(companies: DataFrame, url: str = "url") -> DataFrame:
    return companies.filter((F.coalesce(F.col(url), F.lit("")) != "") & ~F.col(url).isin(*BAD_URLS))


def both_present(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every given column is non-empty."""
    for c in columns:
        rows = rows.filter(F.coalesce(F.col(c), F.lit("")) != "")
    return rows


def best_candidates(candidates: DataFrame) -> DataFrame:
    """``query_name, number``: the candidate whose name equals the query, else the first.

    ``candidates``: query_name, candidate_no, name, number. Aggregated before any join, so a
    name with very many candidates is reduced in the map tasks.
    """
    miss = (F.col("name") != F.col("query_name")).cast("int")
    marked = candidates.withColumn("_miss", F.coalesce(miss, F.lit(1)))
    best = keep_first(marked, ["query_name"], ["_miss", "candidate_no"])
    return best.select("query_name", "number")


def lookup_urls(companies: DataFrame, candidates: DataFrame, details: DataFrame) -> DataFrame:
    """Name to registry number to address; any miss gives the sentinel.

    ``details``: number, detail_no, url; the first detail of a number counts.
    """
    best = best_candidates(candidates).withColumnRenamed("query_name", "company_name")
    first = keep_first(details.select("number", "detail_no", "url"), ["number"], ["detail_no"])
    address = best.join(first.select("number", F.col("url").alias("_url")), "number", "left")
    joined = companies.join(address.select("company_name", "_url"), "company_name", "left")
    return joined.withColumn("url", url_or_sentinel(F.col("_url"))).drop("_url")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def members(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return rows.join(chosen.select(key).distinct(), key, "left_semi")


def top_by_revenue(ranking: DataFrame, limit: int = 500) -> DataFrame:
    return ranking.orderBy(F.col("revenue").desc(), "name").limit(limit)


def encode_labels(rows: DataFrame, labels: DataFrame, column: str, out: str) -> DataFrame:
    """Join the label table; labels it lacks give null.

    Adaptive execution knows the size of the label table when it joins, and picks the strategy.
    """
    ids = labels.select(F.col("label").alias(column), F.col("id").alias(out))
    return rows.join(ids, column, "left")


def encode_with(column: Column, ids: dict[str, int]) -> Column:
    """Encoding by a fixed literal map, without any join."""
    return F.try_element_at(literal_map(ids), column.cast("string"))


def assemble_features(targets: DataFrame, *blocks: DataFrame, key: str = "company_name") -> DataFrame:
    """Targets with every feature block attached; companies without features keep nulls."""
    for block in blocks:
        targets = targets.join(block, key, "left")
    return targets


def zero_filled(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.na.fill(0, subset=columns)


def vector_columns(rows: DataFrame, category: str | None = None) -> list[str]:
    """Columns of flattened vectors, of one category or all."""
    if category is None:
        return [c for c in rows.columns if "_vec_" in c]
    return [c for c in rows.columns if c.startswith(f"{category}_vec_")]


def numeric_columns(rows: DataFrame, drop: tuple[str, ...] = ("company_name", "url", "revenue_class")) -> list[str]:
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [c for c, t in rows.dtypes if c not in drop and (t in numeric or t.startswith("decimal"))]


def present_columns(rows: DataFrame, wanted) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    have = set(rows.columns)
    return [c for c in wanted if c in have]


def page_vector(rows: DataFrame, page: str) -> Column | None:
    """The vector of a page type as one array, chosen by the table's schema: a numeric array column ``{page}_vec``, else
    the columns ``{page}_vec_0``, ``{page}_vec_1``, … by number. None where there are neither; missing values are 0."""
    kind = next((f.dataType for f in rows.schema.fields if f.name == f"{page}_vec"), None)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.transform(F.col(f"{page}_vec").cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
    flat = [c for c in vector_columns(rows, page) if c.removeprefix(f"{page}_vec_").isdigit()]
    flat = [c for c in sorted(flat, key=lambda c: int(c.rpartition("_")[2])) if c in numeric_columns(rows)]
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flat]) if flat else None
