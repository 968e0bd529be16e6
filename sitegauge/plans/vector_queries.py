"""TF-IDF, pooling, scoring, splits and metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rules import REVENUE_IDS
from ..operators import metrics as M
from ..operators import splits, tfidf, vectors
from ..session import scratch_path
from .registry import query, table

SIZE = 64


def _tfidf_sql(key: str) -> str:
    return rf"""
tf AS (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents)
  GROUP BY {key}, term),
nd AS (SELECT count(DISTINCT {key}) AS n FROM documents),
vocab AS (
  SELECT term, sum(tf)::BIGINT AS total, count(*) AS df FROM tf GROUP BY term
  HAVING count(*) >= 3 AND count(*) <= 0.90 * (SELECT n FROM nd)
  ORDER BY total DESC, term LIMIT 500),
idf AS (SELECT term, total, df, ln((1.0 + (SELECT n FROM nd)) / (1 + df)) + 1 AS idf FROM vocab),
w AS (SELECT {key}, term, tf * idf AS w FROM tf JOIN idf USING (term)),
norms AS (SELECT {key}, sqrt(sum(w * w)) AS norm FROM w GROUP BY {key})
"""


def _tfidf(spark, sf_dir, key):
    docs = table(spark, sf_dir, "documents").select(key, "text")
    counts = tfidf.term_counts(docs, key, "text")
    n = docs.agg(F.count_distinct(key).alias("n"))
    return counts, tfidf.fit_vocabulary(counts, n, key)


@query("tfidf_vocab", f"WITH {_tfidf_sql('doc_id')} SELECT term, df, total, round(idf, 6) AS idf FROM idf")
def tfidf_vocab(spark, sf_dir):
    _, vocabulary = _tfidf(spark, sf_dir, "doc_id")
    return vocabulary.terms.select("term", "df", "total", F.round("idf", 6).alias("idf"))


@query(
    "tfidf_weights",
    f"WITH {_tfidf_sql('doc_id')} SELECT doc_id, term, round(w / norm, 6) AS weight FROM w JOIN norms USING (doc_id)",
)
def tfidf_weights(spark, sf_dir):
    counts, vocabulary = _tfidf(spark, sf_dir, "doc_id")
    weights = tfidf.tfidf_weights(counts, vocabulary, "doc_id")
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_by_company",
    f"WITH {_tfidf_sql('source')} SELECT source, term, round(w / norm, 6) AS weight FROM w JOIN norms USING (source)",
)
def tfidf_by_company(spark, sf_dir):
    counts, vocabulary = _tfidf(spark, sf_dir, "source")
    weights = tfidf.tfidf_weights(counts, vocabulary, "source")
    return weights.select("source", "term", F.round("weight", 6).alias("weight"))


@query(
    "tfidf_saved_vocabulary",
    f"WITH {_tfidf_sql('source')} SELECT source, term, round(w / norm, 6) AS weight FROM w JOIN norms USING (source)",
)
def tfidf_saved_vocabulary(spark, sf_dir):
    """Weights from a vocabulary that was written and read back."""
    counts, vocabulary = _tfidf(spark, sf_dir, "source")
    path = scratch_path(spark, "vocabulary")
    tfidf.save_vocabulary(vocabulary, path)
    weights = tfidf.tfidf_weights(counts, tfidf.load_vocabulary(spark, path), "source")
    return weights.select("source", "term", F.round("weight", 6).alias("weight"))


def _long_words():
    """A user's tokenizer: words of at least five letters, digits apart."""
    import re

    word = re.compile(r"[^\W\d_]{5,}")
    return word.findall


@query(
    "tokenizer_terms",
    r"""WITH t AS (SELECT source, i, substring(lower(text), (i * 5000 + 1)::BIGINT, 5000) AS t
                   FROM documents, unnest(range(0, (length(text) + 4999) // 5000)) AS r(i)),
        w AS (SELECT source, unnest(regexp_extract_all(t, '[\p{L}]{5,}')) AS term FROM t)
        SELECT source, term, count(*) AS tf FROM w GROUP BY source, term""",
)
def tokenizer_terms(spark, sf_dir):
    """Term counts by a tokenizer of the user's, which sees windows of 5,000 characters."""
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return tfidf.term_counts(docs, "source", "text", tfidf.tokenizer_udf(_long_words)(F.col("text")))


# ------------------------------------------------------------------ pooling
POOL_CATEGORIES = ("about", "ir", "news", "top")
NAMES_SQL = "['about', 'ir', 'news', 'top', 'recruit']"


def _pages_of_vectors(spark, sf_dir):
    """Five vectors per company, the category by position; some categories stay empty."""
    vec = table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(c) for c in ("about", "ir", "news", "top", "recruit")])
    return vec.select(
        "vec_id",
        F.floor(F.col("vec_id") / 5).alias("company"),
        F.get(names, F.pmod(F.col("vec_id") * F.col("vec_id"), F.lit(5)).cast("int")).alias("category"),
        A.doubles(F.col("embedding")).alias("vector"),
        "label",
    )


@query(
    "mean_pool",
    f"""WITH v AS (SELECT vec_id // 5 AS company, ({NAMES_SQL})[(vec_id * vec_id) % 5 + 1] AS category, embedding FROM embeddings),
        d AS (SELECT company, category, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM v),
        m AS (SELECT company, category, dim, avg(x) AS x FROM d GROUP BY ALL),
        grid AS (SELECT company, category, dim FROM (SELECT DISTINCT vec_id // 5 AS company FROM embeddings),
                 (SELECT unnest(['about', 'ir', 'news', 'top']) AS category), (SELECT unnest(range(64)) AS dim))
        SELECT company, category, dim::INT AS dim, round(coalesce(x, 0.0), 6) + 0.0 AS x
        FROM grid LEFT JOIN m USING (company, category, dim)""",
)
def mean_pool(spark, sf_dir):
    rows = _pages_of_vectors(spark, sf_dir)
    wide = vectors.category_vectors(rows, "company", "category", "vector", POOL_CATEGORIES, SIZE)
    long = wide.select(
        "company",
        F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_vec").alias("v")) for c in POOL_CATEGORIES])).alias("p"),
    ).select("company", "p.category", F.posexplode("p.v").alias("dim", "x"))
    return M.rounded(long, 6, "x")


def _wave(n: int, m: int, phase: float) -> list[list[float]]:
    """Fixed small weights as a smooth function of the position."""
    return [[round(math.sin(phase + 0.7 * i + 0.3 * j), 6) for j in range(m)] for i in range(n)]


ATT_W1, ATT_B1, ATT_W2, ATT_B2 = _wave(4, SIZE, 0.1), [0.1, -0.1, 0.2, 0.0], [2.0, -1.5, 1.0, 0.5], 0.25
_ATT_SQL = " + ".join(
    f"{w2} * tanh(list_dot_product(v, {w1}::DOUBLE[]) + {b1})" for w1, b1, w2 in zip(ATT_W1, ATT_B1, ATT_W2)
)


@query(
    "attention_pool",
    f"""WITH c AS (SELECT vec_id // 5 AS page, vec_id AS o, embedding::DOUBLE[] AS v FROM embeddings),
        w AS (SELECT page, o, v, {_ATT_SQL} + {ATT_B2} AS w FROM c),
        e AS (SELECT page, v, exp(w - max(w) OVER (PARTITION BY page)) AS e FROM w),
        p AS (SELECT page, v, e / sum(e) OVER (PARTITION BY page) AS p FROM e),
        d AS (SELECT page, p, unnest(v) AS x, unnest(range(64)) AS dim FROM p)
        SELECT page, dim::INT AS dim, round(sum(p * x), 6) + 0.0 AS x FROM d GROUP BY page, dim""",
)
def attention_pool(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("page"), "vec_id", A.doubles(F.col("embedding")).alias("v")
    )
    logit = vectors.attention_logit(F.col("v"), ATT_W1, ATT_B1, ATT_W2, ATT_B2)
    pooled = vectors.attention_pool(chunks, ["page"], "vec_id", "v", logit)
    return M.rounded(pooled.select("page", F.posexplode("v").alias("dim", "x")), 6, "x")


PROBS_SQL = """
logits AS (SELECT vec_id, label, vec_id // 5 AS company, list_transform(embedding[1:5], lambda x: 10 * x::DOUBLE) AS z FROM embeddings),
exps AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM logits),
probs AS (SELECT vec_id, label, company, list_transform(e, lambda x: x / list_sum(e)) AS p FROM exps)
"""


def _page_probs(spark, sf_dir):
    """Five class probabilities per page from the first five vector elements."""
    z = F.transform(F.slice(A.doubles(F.col("embedding")), 1, 5), lambda x: 10 * x)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.floor(F.col("vec_id") / 5).alias("company"), A.softmax(z).alias("probs")
    )


@query(
    "ensemble_argmax",
    f"""WITH {PROBS_SQL},
        m AS (SELECT company, count(*) AS n_pages, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4]), avg(p[5])] AS p FROM probs GROUP BY company),
        best AS (SELECT *, list_position(p, list_max(p)) AS i FROM m)
        SELECT company, n_pages, ['A', 'B', 'C', 'D', 'S'][i] AS estimated_class,
          ['8000億円〜2兆円未満', '5000億円〜8000億円未満', '〜5000億円未満', 'スタートアップ企業', '2兆円以上'][i] AS estimated_range,
          round(list_max(p), 4) AS confidence, round(p[5], 4) AS p_s, round(p[1], 4) AS p_a, round(p[2], 4) AS p_b,
          round(p[3], 4) AS p_c, round(p[4], 4) AS p_d, 'ok' AS status FROM best""",
)
def ensemble_argmax(spark, sf_dir):
    out = vectors.company_scores(_page_probs(spark, sf_dir), "company", "probs", REVENUE_IDS)
    return out.select(
        "company",
        "n_pages",
        "estimated_class",
        "estimated_range",
        "confidence",
        *[F.col("class_probabilities")[c].alias(f"p_{c.lower()}") for c in ("S", "A", "B", "C", "D")],
        "status",
    )


@query(
    "pad_mask",
    """WITH kept AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations),
        chunk AS (
          SELECT conv_id, role, rn, list_transform(string_split(text, ' '), lambda w: length(w))[1:16] AS ids FROM kept WHERE rn <= 4),
        grid AS (SELECT conv_id, role, r AS rn FROM (SELECT DISTINCT conv_id, role FROM conversations), (SELECT unnest([1, 2, 3, 4]) AS r)),
        cells AS (
          SELECT conv_id, role, rn, ids IS NOT NULL AS present,
                 list_transform(range(1, 17), lambda i: coalesce(ids[i], 0)) AS padded,
                 list_transform(range(1, 17), lambda i: CASE WHEN i <= coalesce(len(ids), 0) THEN 1 ELSE 0 END) AS mask
          FROM grid LEFT JOIN chunk USING (conv_id, role, rn))
        SELECT conv_id, role, string_agg(array_to_string(padded, ','), ';' ORDER BY rn) AS input_ids,
               string_agg(array_to_string(mask, ','), ';' ORDER BY rn) AS attention_mask,
               string_agg(CASE WHEN present THEN '1' ELSE '0' END, ',' ORDER BY rn) AS chunk_mask
        FROM cells GROUP BY conv_id, role""",
)
def pad_mask(spark, sf_dir):
    """Turns as chunks, word lengths as token ids."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "ids", F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    )
    out = vectors.padded_pages(turns, ["conv_id", "role"], "turn", "ids", max_chunks=4, max_tokens=16)

    def flat(c):
        return F.array_join(F.transform(c, lambda r: F.array_join(r.cast("array<string>"), ",")), ";")

    return out.select(
        "conv_id",
        "role",
        flat(F.col("input_ids")).alias("input_ids"),
        flat(F.col("attention_mask")).alias("attention_mask"),
        F.array_join(F.col("chunk_mask").cast("array<string>"), ",").alias("chunk_mask"),
    )


# ------------------------------------------------------------------ splits
@query(
    "group_split",
    """SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || '|42'), c_custkey)
              <= ceil(round(0.2 * count(*) OVER (), 9)) AS is_test FROM customer""",
)
def group_split(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").select("c_custkey")
    return splits.split_companies(companies, "c_custkey")


@query(
    "strat_split",
    """SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|42'), c_custkey)
              <= ceil(round(0.2 * count(*) OVER (PARTITION BY c_mktsegment), 9)) AS is_test FROM customer""",
)
def strat_split(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return splits.split_companies(companies, "c_custkey", by="c_mktsegment")


@query(
    "split_rows",
    """WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || '|42'), c_custkey)
              <= ceil(round(0.2 * count(*) OVER (), 9)) AS is_test FROM customer)
       SELECT is_test, count(*) AS orders, count(DISTINCT o_custkey) AS customers
       FROM orders JOIN s ON o_custkey = c_custkey GROUP BY is_test""",
)
def split_rows(spark, sf_dir):
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    chosen = splits.split_companies(companies, "o_custkey")
    orders = splits.apply_split(table(spark, sf_dir, "orders"), chosen, "o_custkey", "is_test")
    per = orders.groupBy("is_test", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("is_test").agg(F.sum("n").alias("orders"), F.count(F.lit(1)).alias("customers"))


FOLDS_SQL = """
folds AS (SELECT vec_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || '|42'), vec_id) - 1) % 5)::INT AS fold
          FROM embeddings)
"""


@query("kfold", f"WITH {FOLDS_SQL} SELECT vec_id, label, fold FROM folds")
def kfold(spark, sf_dir):
    return splits.stratified_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query(
    "company_first_labels",
    "SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id",
)
def company_first_labels(spark, sf_dir):
    return splits.company_labels(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn")


# ------------------------------------------------------------------ classification metrics
PRED_SQL = """
predicted AS (SELECT vec_id, label, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::INT AS pred FROM embeddings)
"""


def _predicted(spark, sf_dir):
    """A crude classifier: position of the largest of the first ten elements."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", A.argmax(F.slice("embedding", 1, 10)).alias("pred")
    )


REPORT_SQL = """
cls AS (SELECT label AS c FROM predicted UNION SELECT pred FROM predicted),
per AS (
  SELECT c, (SELECT count(*) FROM predicted WHERE label = c AND pred = c) AS tp,
         (SELECT count(*) FROM predicted WHERE label = c) AS support,
         (SELECT count(*) FROM predicted WHERE pred = c) AS chosen FROM cls),
prf AS (
  SELECT c::VARCHAR AS class, CASE WHEN chosen > 0 THEN tp / chosen ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
         CASE WHEN tp > 0 THEN 2 * tp / (chosen + support) ELSE 0 END AS f1, support, tp FROM per),
report AS (
  SELECT class, precision, recall, f1, support FROM prf
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support)::BIGINT FROM prf
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM prf
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), sum(support)::BIGINT FROM prf)
"""


@query(
    "classification_report",
    f"""WITH {PRED_SQL}, {REPORT_SQL}
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report""",
)
def classification_report(spark, sf_dir):
    report = M.classification_report(_predicted(spark, sf_dir), "label", "pred")
    return M.rounded(report, 6, "precision", "recall", "f1")


@query(
    "confusion_matrix",
    f"""WITH {PRED_SQL} SELECT t AS "true", {', '.join(f"count(*) FILTER (pred = {c}) AS pred_{c}" for c in range(10))}
        FROM (SELECT unnest(range(10))::INT AS t) LEFT JOIN predicted ON label = t GROUP BY t""",
)
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_predicted(spark, sf_dir), "label", "pred", list(range(10)))


@query(
    "company_accuracy",
    f"""WITH {PROBS_SQL},
        c AS (SELECT company, min(label) % 5 AS label, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4]), avg(p[5])] AS p FROM probs GROUP BY company)
        SELECT round(avg(CASE WHEN label = list_position(p, list_max(p)) - 1 THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM c""",
)
def company_accuracy(spark, sf_dir):
    """A company's estimate is the largest of its pages' mean probabilities."""
    companies = M.company_predictions(_page_probs(spark, sf_dir), "company", "label", "probs")
    return M.rounded(M.accuracy(companies.withColumn("label", F.col("label") % 5), "label", "pred"), 6, "accuracy")


@query(
    "cross_entropy",
    f"WITH {PROBS_SQL} SELECT round(avg(-ln(p[label % 5 + 1])), 6) AS cross_entropy FROM probs",
)
def cross_entropy(spark, sf_dir):
    pages = _page_probs(spark, sf_dir).withColumn("y", F.col("label") % 5)
    return M.rounded(M.cross_entropy(pages, "probs", "y"), 6, "cross_entropy")


@query(
    "fold_summary",
    f"""WITH {PRED_SQL}, {FOLDS_SQL},
        f AS (SELECT fold, p.label, pred FROM predicted p JOIN folds USING (vec_id)),
        cls AS (SELECT fold, label AS c FROM f UNION SELECT fold, pred FROM f),
        per AS (SELECT fold, c, (SELECT count(*) FROM f WHERE f.fold = cls.fold AND label = c AND pred = c) AS tp,
                  (SELECT count(*) FROM f WHERE f.fold = cls.fold AND label = c) AS sup,
                  (SELECT count(*) FROM f WHERE f.fold = cls.fold AND pred = c) AS chosen FROM cls),
        g AS (SELECT fold, sum(tp) / sum(sup) AS acc, avg(CASE WHEN tp > 0 THEN 2 * tp / (sup + chosen) ELSE 0 END) AS f1 FROM per GROUP BY fold)
        SELECT round(avg(acc), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, count(*) AS folds FROM g""",
)
def fold_summary(spark, sf_dir):
    folds = splits.stratified_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")
    rows = _predicted(spark, sf_dir).join(folds.select("vec_id", "fold"), "vec_id")
    return M.rounded(M.fold_summary(rows, "fold", "label", "pred"), 6, "accuracy", "macro_f1")


# ------------------------------------------------------------------ feature-space metrics
@query(
    "kde_by_class",
    """WITH v AS (SELECT lang, ln(1 + n_chars) AS x FROM documents),
       s AS (SELECT lang, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v GROUP BY lang),
       g AS (SELECT lang, i AS point_no, n, h, lo - 3 * h + (hi - lo + 6 * h) * i / 49 AS gx FROM s, (SELECT unnest(range(50)) AS i)),
       k AS (SELECT g.lang, point_no, gx, sum(exp(-(((gx - x) / h) ** 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS d
             FROM g JOIN v USING (lang) GROUP BY g.lang, point_no, gx)
       SELECT lang, point_no::INT AS point_no, round(gx, 6) AS x, round(d, 6) + 0.0 AS density FROM k""",
)
def kde_by_class(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.log1p("n_chars").alias("size"))
    return M.rounded(M.density_by_class(docs, "lang", "size", points=50), 6, "x", "density")


@query(
    "calinski_harabasz",
    """WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
       mu AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM d GROUP BY label, dim),
       g AS (SELECT dim, avg(x) AS m FROM d GROUP BY dim),
       b AS (SELECT sum(mu.n * (mu.m - g.m) ** 2) AS b FROM mu JOIN g USING (dim)),
       w AS (SELECT sum((x - m) ** 2) AS w FROM d JOIN mu USING (label, dim)),
       c AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
       SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz, n, k FROM b, w, c""",
)
def calinski_harabasz(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return M.rounded(M.calinski_harabasz(rows, "label", "embedding"), 6, "calinski_harabasz")


@query(
    "silhouette",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
       p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e) ** 2) AS s, count(*) AS n
             FROM v a, v b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
       q AS (SELECT vec_id, sum(CASE WHEN own = other THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p GROUP BY vec_id)
       SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM q""",
)
def silhouette(spark, sf_dir):
    return M.rounded(M.silhouette(table(spark, sf_dir, "embeddings"), "label", "embedding"), 6, "silhouette")


@query(
    "silhouette_euclidean",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
       p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)) AS s, count(*) AS n
             FROM v a, v b WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
       q AS (SELECT vec_id, sum(CASE WHEN own = other THEN s / n END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p GROUP BY vec_id)
       SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM q""",
)
def silhouette_euclidean(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return M.rounded(M.silhouette_euclidean(rows, "label", "embedding", block_rows=256), 6, "silhouette")
