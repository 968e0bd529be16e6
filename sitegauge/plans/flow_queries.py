"""Round trips through files, the link frontier, and streams; each reads the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import arrays as A
from ..functions.rules import FAILED_CATEGORY, REVENUE_IDS
from ..functions.text import fixed_chunks
from ..functions.urls import url_netloc
from ..operators import corpus, crawl, pages, ranking
from ..session import cut_lineage, scratch_path
from ..sources import readers, writers
from ..streaming import jobs
from .registry import query, table
from .text_queries import CHUNKS_SQL, PAGE_TEXT_SQL
from .vector_queries import PROBS_SQL


def _records(spark, sf_dir):
    """Documents in the shape of page-text records."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.col("source").alias("company_name"),
        F.lit("C").alias("revenue_class"),
        F.concat(F.lit("https://"), "source", F.lit(".example/")).alias("url"),
        F.col("lang").alias("page_category"),
        F.col("text").alias("text_content"),
    )


# ------------------------------------------------------------------ sources and sinks
@query(
    "jsonl_tolerant",
    """SELECT source AS company_name, CASE WHEN lang = 'en' THEN '' ELSE lang END AS page_category,
              count(*) AS n, sum(length(text))::BIGINT AS chars
       FROM documents WHERE lang <> 'fr' GROUP BY ALL""",
)
def jsonl_tolerant(spark, sf_dir):
    """Every French record is cut short and cannot be parsed; English ones lack the category."""
    rec = _records(spark, sf_dir).withColumn(
        "page_category", F.when(F.col("page_category") != "en", F.col("page_category"))
    )
    line = F.to_json(F.struct(*[f.name for f in schemas.PAGE_TEXT.fields]))
    broken = F.coalesce(F.col("page_category") == "fr", F.lit(False))
    path = scratch_path(spark, "jsonl")
    cut = F.when(broken, F.left("line", F.length("line") - 5)).otherwise(F.col("line"))
    rec.withColumn("line", line).select(cut.alias("value")).write.text(path)
    back = readers.read_jsonl_tolerant(spark, path)
    return back.groupBy("company_name", "page_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text_content")).alias("chars")
    )


@query(
    "jsonl_roundtrip",
    """SELECT 'https://' || source || '.example/' AS url, lang AS page_category, md5(text) AS digest
       FROM documents WHERE trim(text) <> ''""",
)
def jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    writers.append_jsonl(_records(spark, sf_dir).drop("doc_id"), path)
    return readers.read_jsonl_strict(spark, path).select("url", "page_category", F.md5("text_content").alias("digest"))


@query(
    "csv_roundtrip",
    f"""WITH {CHUNKS_SQL} SELECT source AS company_name, 'C' AS revenue_class, lang AS page_category, md5(chunk) AS digest
        FROM chunks WHERE length(chunk) >= 50""",
)
def csv_roundtrip(spark, sf_dir):
    """The chunk table through quoted CSV, line breaks and quotes included."""
    keys = ["company_name", "revenue_class", "page_category"]
    chunks = corpus.chunk_records(_records(spark, sf_dir), "text_content", keys)
    path = scratch_path(spark, "chunks")
    writers.write_chunks_csv(chunks.select(*keys, F.col("chunk").alias("text")), path)
    back = readers.read_chunks_csv(spark, path)
    return back.select(*keys, F.md5("text").alias("digest"))


@query(
    "csv_append",
    """SELECT c_name AS company_name, '' AS url, 'C' AS revenue_class FROM customer
       UNION ALL SELECT s_name, 'https://s.example/' || s_suppkey, 'D' FROM supplier""",
)
def csv_append(spark, sf_dir):
    """Company list with start-ups appended, then read back."""
    listed = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("company_name"), F.lit("").alias("url"), F.lit("C").alias("revenue_class")
    )
    startups = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("company_name"),
        F.concat(F.lit("https://s.example/"), F.col("s_suppkey").cast("string")).alias("url"),
        F.lit("D").alias("revenue_class"),
    )
    path = scratch_path(spark, "companies")
    writers.write_csv(listed, path)
    writers.append_csv(startups, path)
    return readers.read_csv_strings(spark, path, multi_line=False)


@query(
    "ranking_unwrap",
    "SELECT c_name AS name, c_acctbal AS revenue FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
)
def ranking_unwrap(spark, sf_dir):
    """Two ranking documents per nation, wrapped (customers) and bare (suppliers), unwrapped again."""
    wrapped = table(spark, sf_dir, "customer").select(
        F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))).alias("data"))).alias("value")
    )
    bare = table(spark, sf_dir, "supplier").select(
        F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"))).alias("value")
    )
    either = T.StructType([*schemas.RANKING_ENVELOPE.fields, *schemas.RANKING_ITEM.fields])
    docs = wrapped.unionByName(bare).select(F.from_json("value", either).alias("d")).select("d.*")
    return readers.unwrap_ranking(docs)


@query(
    "ranking_files",
    "SELECT c_name AS name, c_acctbal AS revenue FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier",
)
def ranking_files(spark, sf_dir):
    """Ranking documents of up to a hundred companies, a file each: customers in an envelope, suppliers as bare lists."""
    path = scratch_path(spark, "rankings")

    def documents(rows, key, name, value):
        item = F.struct(F.col(name).alias("name"), F.col(value).alias("value"))
        return rows.groupBy(F.floor(F.col(key) / 100)).agg(F.collect_list(item).alias("data"))

    wrapped = documents(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_acctbal").select(F.to_json(F.struct("data")).alias("value"))
    bare = documents(table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", "s_acctbal").select(F.to_json("data").alias("value"))
    wrapped.unionByName(bare).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_ranking(spark, path)


@query(
    "parquet_overwrite",
    "SELECT doc_id, source, length(text) AS chars FROM documents WHERE lang = 'en'",
)
def parquet_overwrite(spark, sf_dir):
    """A feature table written over an older one."""
    path = scratch_path(spark, "overwritten")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.length("text").cast("long").alias("chars"))
    writers.write_parquet(docs, path)
    writers.write_parquet(docs.filter(F.col("lang") == "en").drop("lang"), path)
    return readers.read_parquet(spark, path)


@query(
    "label_map_roundtrip",
    """SELECT 'category2id' AS kind, label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM (SELECT DISTINCT lang AS label FROM documents)
       UNION ALL
       SELECT 'revenue2id', label, (row_number() OVER (ORDER BY label) - 1)::INT FROM (SELECT DISTINCT source AS label FROM documents)""",
)
def label_map_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang")
    labels = (
        ranking.label_ids(docs, "source").select(F.lit("revenue2id").alias("kind"), "label", "id")
    ).unionByName(ranking.label_ids(docs, "lang").select(F.lit("category2id").alias("kind"), "label", "id"))
    path = scratch_path(spark, "labels")
    writers.write_label_maps(labels, path)
    return readers.read_label_maps(spark, path)


@query(
    "incremental_append",
    "SELECT doc_id, source, n_chars FROM documents",
)
def incremental_append(spark, sf_dir):
    """English documents first, then all: the second append adds only the new ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    english = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(*docs.columns)
    path = scratch_path(spark, "features")
    writers.append_new(english, path, "doc_id")
    writers.append_new(docs, path, "doc_id")
    return readers.read_parquet(spark, path, docs.schema)


@query(
    "failure_rows",
    f"""SELECT c_name AS company_name, 'C' AS revenue_class, 'https://c.example/' || c_custkey AS url,
               '{FAILED_CATEGORY}' AS page_category, '' AS text_content
        FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL
        SELECT c_name, 'C', 'https://c.example/' || c_custkey, 'top', max(o_orderpriority)
        FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_name, c_custkey""",
)
def failure_rows(spark, sf_dir):
    """Customers without orders stand for companies whose crawl gave nothing."""
    newest = (
        table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("text_content"))
    )
    rows = table(spark, sf_dir, "customer").join(newest, "c_custkey", "left").select(
        F.col("c_name").alias("company_name"),
        F.lit("C").alias("revenue_class"),
        F.concat(F.lit("https://c.example/"), F.col("c_custkey").cast("string")).alias("url"),
        F.lit("top").alias("page_category"),
        "text_content",
    )
    failed = corpus.failure_rows(rows, F.col("text_content").isNull())
    return rows.filter(F.col("text_content").isNotNull()).unionByName(failed)


@query(
    "saved_counts",
    "SELECT conv_id, count(*) AS saved_categories, sum(length(text))::BIGINT AS saved_chars FROM conversations GROUP BY conv_id",
)
def saved_counts(spark, sf_dir):
    return corpus.saved_counts(table(spark, sf_dir, "conversations"), ["conv_id"], "text")


# ------------------------------------------------------------------ frontier
def _frontier_sql(local: bool) -> str:
    """Three unrolled rounds of the same rules, over the derived link table."""
    dst = (
        "JOIN r AS t ON t.host = s.host AND t.rank = (3 * s.rank + k) % s.size"
        if local
        else "JOIN r AS t ON t.page_id = (3 * s.page_id + k) % s.total"
    )
    rounds = []
    for d in (1, 2, 3):
        seen = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(d))
        rounds.append(
            f"""reach{d} AS ({seen}),
        full{d} AS (SELECT company, category FROM reach{d} JOIN size USING (url)
                   GROUP BY ALL HAVING sum(CASE WHEN chars > 50 THEN 1 + least(chars, 2000) ELSE 0 END) >= 2000),
        d{d} AS (SELECT company, target AS url, arg_min(category, (src, link_no)) AS category, {d} AS depth
          FROM (SELECT f.company, l.* FROM d{d - 1} f JOIN links l ON l.src = f.url
                WHERE NOT EXISTS (SELECT 1 FROM full{d} u WHERE u.company = f.company AND u.category = l.category)
                  AND NOT EXISTS (SELECT 1 FROM reach{d} v WHERE v.company = f.company AND v.url = l.target))
          GROUP BY company, target)"""
        )
    return f"""WITH {PAGE_TEXT_SQL},
        base AS (SELECT page_id, regexp_replace(url, '#.*$', '') || '/' || page_id AS url, regexp_extract(url, '://([^/?#]*)', 1) AS host, length(text) AS chars
                 FROM page_text),
        r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS rank,
                     count(*) OVER (PARTITION BY host) AS size, count(*) OVER () AS total FROM base),
        ks AS (SELECT unnest([0, 1, 2]) AS k),
        links AS (SELECT s.url AS src, k AS link_no, t.url AS target,
                         ['about', 'business', 'news'][((s.page_id + k) % 3 + 1)::INT] AS category
                  FROM r AS s CROSS JOIN ks {dst}),
        size AS (SELECT url, chars FROM base),
        d0 AS (SELECT host AS company, url, 'top' AS category, 0 AS depth FROM r WHERE rank = 0),
        {', '.join(rounds)}
        SELECT company, url, category, depth::INT AS depth FROM (SELECT * FROM reach3 UNION ALL SELECT * FROM d3)"""


def _frontier(spark, sf_dir, local: bool):
    """No link of the fixture leads to a stored page, so links are derived from page numbers:
    page r of m points to pages (3r + k) mod m, inside its host or over all pages."""
    texts = pages.page_texts(table(spark, sf_dir, "pages"), min_chars=None)
    plain = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("/"), F.col("page_id").cast("string"))
    base = cut_lineage(
        texts.select(
            "page_id", plain.alias("url"), url_netloc(F.col("url")).alias("host"), F.length("text").alias("chars")
        )
    )
    keys = ["host"] if local else []
    ranked = ranking.group_rank(base, ["host"], "page_id", "rank")
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    numbered = ranked.join(sizes, keys) if local else ranked.withColumn("size", sizes.scalar())
    spot = F.col("rank") if local else F.col("page_id")
    names = F.array(F.lit("about"), F.lit("business"), F.lit("news"))
    out = numbered.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        *keys,
        F.col("url").alias("src"),
        F.col("k").alias("link_no"),
        F.get(names, ((F.col("page_id") + F.col("k")) % 3).cast("int")).alias("category"),
        ((3 * spot + F.col("k")) % F.col("size")).alias("to"),
    )
    ends = numbered.select(*keys, spot.alias("to"), F.col("url").alias("target"))
    links = out.join(ends, [*keys, "to"]).select("src", "link_no", "target", "category")
    seeds = ranked.filter(F.col("rank") == 0).select(F.col("host").alias("company"), "url")
    return crawl.expand_frontier(seeds, links, base.select("url", "chars"), budget=2_000, any_domain=not local)


@query("frontier_expand", _frontier_sql(local=True))
def frontier_expand(spark, sf_dir):
    """Same-domain links from each host's first page."""
    return _frontier(spark, sf_dir, local=True)


@query("frontier_any_domain", _frontier_sql(local=False))
def frontier_any_domain(spark, sf_dir):
    """An empty allowed domain admits every link."""
    return _frontier(spark, sf_dir, local=False)


# ------------------------------------------------------------------ streams
EMBEDDINGS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


@query(
    "stream_score",
    f"""WITH {PROBS_SQL},
        m AS (SELECT company, count(*) AS n_pages, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4]), avg(p[5])] AS p FROM probs GROUP BY company)
        SELECT company, n_pages, ['A', 'B', 'C', 'D', 'S'][list_position(p, list_max(p))] AS estimated_class,
               round(list_max(p), 4) AS confidence FROM m""",
)
def stream_score(spark, sf_dir):
    """Page probabilities as a stream, running company means; equals the batch result."""
    stream = jobs.file_stream(spark, f"{sf_dir}/embeddings.parque[t]", EMBEDDINGS)
    z = F.transform(F.slice(A.doubles(F.col("embedding")), 1, 5), lambda x: 10 * x)
    scored = stream.select(F.floor(F.col("vec_id") / 5).alias("company"), A.softmax(z).alias("probs"))
    out, marks = scratch_path(spark, "scores"), scratch_path(spark, "marks")
    jobs.start_scores(scored, "company", "probs", len(REVENUE_IDS), out, marks).awaitTermination()
    means = jobs.latest_scores(spark, out, "company")
    label = F.get(F.array(*[F.lit(c) for c in sorted(REVENUE_IDS)]), A.argmax(F.col("probs")))
    return means.select(
        "company", "n_pages", label.alias("estimated_class"), F.round(F.array_max("probs"), 4).alias("confidence")
    )


@query(
    "incremental_features",
    f"""WITH {CHUNKS_SQL} SELECT doc_id, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars
        FROM chunks GROUP BY doc_id""",
)
def incremental_features(spark, sf_dir):
    """Chunk counts per document from parts of documents that come in different batches, a file each;
    the second start finds nothing new."""
    out, marks, parts = (scratch_path(spark, n) for n in ("stream-features", "marks", "stream-parts"))
    docs = table(spark, sf_dir, "documents")
    # Ten chunks to a part, so that chunks of parts are chunks of the document.
    split = docs.select("doc_id", F.posexplode(fixed_chunks(F.col("text"), 10 * corpus.CHUNK_CHARS)).alias("part", "text"))
    split.repartition(4, "part", "doc_id").write.parquet(parts)

    def build(docs):
        chunks = corpus.chunk_records(docs, "text", ["doc_id"], min_chars=1)
        return chunks.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars")
        )

    for _ in range(2):
        stream = jobs.file_stream(spark, parts, split.schema, files_per_batch=1)
        jobs.start_features(stream, "doc_id", build, out, marks).awaitTermination()
    return jobs.read_features(spark, out, "doc_id")


@query(
    "stream_dedup",
    "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
)
def stream_dedup(spark, sf_dir):
    """Repeated records count once, however far apart they come."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    out, marks, parts = (scratch_path(spark, n) for n in ("events", "marks", "event-parts"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    twice.repartition(4, "copy", "event_id").write.parquet(parts)
    stream = jobs.file_stream(spark, parts, twice.schema, files_per_batch=1)
    build = lambda b: b.select("event_id", "event_type")
    jobs.start_features(stream, "event_id", build, out, marks, distinct=True).awaitTermination()
    return jobs.read_features(spark, out, "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
