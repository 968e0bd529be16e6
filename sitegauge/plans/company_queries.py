"""Company list, lookups, set operations and label encoding over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import STARTUP_CLASS
from ..operators import companies as C
from ..operators import metrics, ranking
from .registry import query, table

FLOORS = (("S", 3_000_000), ("A", 2_000_000), ("B", 1_000_000))

RANKING_SQL = """
ranking AS (
  SELECT c_name AS name, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS revenue
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name),
bucketed AS (
  SELECT name, CAST(revenue AS DOUBLE) AS revenue,
         CASE WHEN revenue >= 3000000 THEN 'S' WHEN revenue >= 2000000 THEN 'A'
              WHEN revenue >= 1000000 THEN 'B' ELSE 'C' END AS revenue_class
  FROM ranking WHERE name <> '' AND revenue IS NOT NULL)
"""


def ranking_rows(spark, sf_dir):
    """Revenue per customer; customers without orders have none and are dropped later."""
    spent = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue"))
    )
    named = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return named.join(spent, "c_custkey", "left").select("name", "revenue")


def bucketed(spark, sf_dir):
    rows = C.with_revenue_class(ranking_rows(spark, sf_dir), floors=FLOORS)
    return rows.withColumn("revenue", F.col("revenue").cast("double"))


@query("revenue_bucket", f"WITH {RANKING_SQL} SELECT name, revenue, revenue_class FROM bucketed")
def revenue_bucket(spark, sf_dir):
    return bucketed(spark, sf_dir)


@query(
    "top_n",
    f"WITH {RANKING_SQL} SELECT name, revenue, revenue_class FROM bucketed ORDER BY revenue DESC, name LIMIT 500",
)
def top_n(spark, sf_dir):
    return C.top_by_revenue(bucketed(spark, sf_dir), 500)


@query(
    "class_distribution",
    f"WITH {RANKING_SQL} SELECT revenue_class, count(*) AS n FROM bucketed GROUP BY revenue_class",
)
def class_distribution(spark, sf_dir):
    return metrics.class_distribution(bucketed(spark, sf_dir), "revenue_class")


CANDIDATES_SQL = """
candidates AS (
  SELECT c_name AS query_name, o_orderkey AS candidate_no, o_orderkey AS number,
         CASE WHEN o_orderstatus = 'F' THEN c_name ELSE o_orderpriority END AS name
  FROM orders JOIN customer ON o_custkey = c_custkey),
best AS (
  SELECT query_name, number FROM (
    SELECT *, row_number() OVER (PARTITION BY query_name
              ORDER BY CASE WHEN name = query_name THEN 0 ELSE 1 END, candidate_no) AS rn FROM candidates)
  WHERE rn = 1)
"""


def _candidates(spark, sf_dir):
    """An order is a registry entry of its customer; finished orders carry the exact name."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderpriority"
    )
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    entry = orders.join(names, "c_custkey")
    exact = F.when(F.col("o_orderstatus") == "F", F.col("c_name")).otherwise(F.col("o_orderpriority"))
    return entry.select(
        F.col("c_name").alias("query_name"),
        F.col("o_orderkey").alias("candidate_no"),
        exact.alias("name"),
        F.col("o_orderkey").alias("number"),
    )


@query("best_candidate", f"WITH {CANDIDATES_SQL} SELECT query_name, number FROM best")
def best_candidate(spark, sf_dir):
    return C.best_candidates(_candidates(spark, sf_dir))


TWO_HOP_SQL = f"""
WITH {CANDIDATES_SQL},
detail AS (
  SELECT l_orderkey AS number, CASE WHEN l_returnflag = 'R' THEN ''
         ELSE 'https://' || lower(l_returnflag) || '.example/' || l_partkey END AS url
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1),
found AS (
  SELECT c_name AS company_name, CASE WHEN d.url IS NULL OR d.url = '' THEN 'NOT_FOUND' ELSE d.url END AS url
  FROM customer LEFT JOIN best ON query_name = c_name LEFT JOIN detail d ON d.number = best.number)
"""


def _with_urls(spark, sf_dir):
    address = F.concat(
        F.lit("https://"), F.lower("l_returnflag"), F.lit(".example/"), F.col("l_partkey").cast("string")
    )
    details = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("number"),
        F.struct("l_linenumber", "l_partkey").alias("detail_no"),
        F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(address).alias("url"),
    )
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("company_name"))
    return C.lookup_urls(names, _candidates(spark, sf_dir), details)


@query("two_hop_lookup", f"{TWO_HOP_SQL} SELECT company_name, url FROM found")
def two_hop_lookup(spark, sf_dir):
    return _with_urls(spark, sf_dir)


@query("crawlable_companies", f"{TWO_HOP_SQL} SELECT company_name, url FROM found WHERE url <> '' AND url NOT IN ('NOT_FOUND', 'ERROR')")
def crawlable_companies(spark, sf_dir):
    return C.crawlable(_with_urls(spark, sf_dir))


@query(
    "resume_anti",
    """SELECT c_custkey, c_name FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def resume_anti(spark, sf_dir):
    """Customers without a finished order."""
    done = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    todo = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return C.not_done(todo, done.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(
    "membership_semi",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def membership_semi(spark, sf_dir):
    chosen = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return C.members(rows, chosen.select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


LABEL_SQL = """
label_ids AS (
  SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id
  FROM (SELECT DISTINCT o_orderpriority AS label FROM orders))
"""


@query("label_map", f"WITH {LABEL_SQL} SELECT label, id FROM label_ids")
def label_map(spark, sf_dir):
    return ranking.label_ids(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "label_encode",
    f"WITH {LABEL_SQL} SELECT o_orderkey, id AS label_id FROM orders LEFT JOIN label_ids ON label = o_orderpriority",
)
def label_encode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    labels = ranking.label_ids(orders, "o_orderpriority")
    return C.encode_labels(orders, labels, "o_orderpriority", "label_id").select("o_orderkey", "label_id")


@query(
    "union_ragged",
    f"""WITH {RANKING_SQL} SELECT name, revenue, revenue_class, NULL::INT AS nation FROM bucketed
        UNION ALL SELECT s_name, NULL, 'D', s_nationkey FROM supplier""",
)
def union_ragged(spark, sf_dir):
    """Ranked companies followed by start-ups, which have a constant class and no revenue."""
    startups = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"),
        F.lit(STARTUP_CLASS).alias("revenue_class"),
        F.col("s_nationkey").alias("nation"),
    )
    return ranking.union_ragged(bucketed(spark, sf_dir), startups)


@query(
    "region_chain",
    """SELECT c_name AS company_name, coalesce(n_name, 'NOT_FOUND') AS nation, coalesce(r_name, 'NOT_FOUND') AS region
       FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def region_chain(spark, sf_dir):
    """Chained lookups with a sentinel for every miss."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(nation, "c_nationkey", "left").join(region, "n_regionkey", "left")
    return rows.select(
        F.col("c_name").alias("company_name"),
        F.coalesce("n_name", F.lit("NOT_FOUND")).alias("nation"),
        F.coalesce("r_name", F.lit("NOT_FOUND")).alias("region"),
    )


@query(
    "assembled_features",
    """SELECT source, coalesce(docs, 0) AS docs, coalesce(chars, 0)::BIGINT AS chars,
              coalesce(good, 0)::BIGINT AS good, coalesce(toxic, 0)::BIGINT AS toxic
       FROM (SELECT DISTINCT source FROM documents)
       LEFT JOIN (SELECT source, count(*) AS docs, sum(n_chars) AS chars FROM documents WHERE lang = 'en' GROUP BY source) USING (source)
       LEFT JOIN (SELECT source, sum(quality) AS good, sum(l.toxic) AS toxic FROM documents JOIN labels l USING (doc_id) GROUP BY source) USING (source)""",
)
def assembled_features(spark, sf_dir):
    """Targets with two feature blocks; missing blocks filled with zero."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    sizes = docs.filter(F.col("lang") == "en").groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars")
    )
    labels = table(spark, sf_dir, "labels")
    marks = docs.select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(
        F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")
    )
    targets = docs.select("source").distinct()
    out = C.assemble_features(targets, sizes, marks, key="source")
    return C.zero_filled(out, C.numeric_columns(out, drop=("source",)))


@query(
    "nested_json",
    """SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k_sum,
              count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 50) AS large
       FROM events GROUP BY event_type""",
)
def nested_json(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("p.k").alias("k_sum"),
        F.count(F.when(F.col("p.k") > 50, 1)).alias("large"),
    )
