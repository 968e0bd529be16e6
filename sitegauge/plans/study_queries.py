"""Scaling, projection, neighbour metrics, encoding, training and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.rules import CATEGORY_IDS, REVENUE_IDS
from ..operators import learn, neighbours, pages, splits, vectors
from ..operators import metrics as M
from ..operators.companies import encode_with
from ..operators.estimate import Estimator, company_estimates
from ..session import cut_lineage
from .registry import query, table
from .text_queries import HOST, PAGE_TEXT_SQL, SECTION, _host, _section
from .vector_queries import FOLDS_SQL, POOL_CATEGORIES, SIZE, _pages_of_vectors, _wave


@query(
    "standardise",
    """WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
       s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM d GROUP BY dim)
       SELECT vec_id, dim::INT AS dim, round((x - m) / sd, 6) + 0.0 AS z FROM d JOIN s USING (dim)""",
)
def standardise(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = learn.fit_scaler(rows, "embedding").transform(rows, "embedding")
    return M.rounded(scaled.select("vec_id", F.posexplode("embedding").alias("dim", "z")), 6, "z")


@query(
    "pca_variance",
    """WITH d AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM embeddings),
       s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM d GROUP BY dim),
       z AS (SELECT vec_id, dim, (x - m) / sd AS z FROM d JOIN s USING (dim)),
       c AS MATERIALIZED (SELECT a.dim AS i, b.dim AS j, avg(a.z * b.z) AS c FROM z a JOIN z b USING (vec_id) GROUP BY ALL),
       cc AS (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY ALL)
       SELECT 'variances' AS measure, round(sum(c), 5) + 0.0 AS value FROM c WHERE i = j
       UNION ALL SELECT 'variances squared', round(sum(c * c), 5) FROM c
       UNION ALL SELECT 'variances cubed', round(sum(a.c * b.c), 5) FROM cc a JOIN c b ON a.i = b.j AND a.j = b.i
       UNION ALL SELECT 'worst remainder', 0.0
       UNION ALL SELECT 'worst difference of the first 50', 0.0
       UNION ALL SELECT 'worst difference to the variance of scores', 0.0""",
)
def pca_variance(spark, sf_dir):
    """Power sums of all variances along the components of the standardised vectors, which equal the traces of the
    covariance and its powers; how far the components are from being eigenvectors; the 50 largest sought alone."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    scaled = cut_lineage(learn.fit_scaler(rows, "embedding").transform(rows, "embedding"), "scaled")
    whole, first = learn.fit_pca(scaled, "embedding", SIZE), learn.fit_pca(scaled, "embedding", 50)
    scores = learn.project(scaled, "embedding", first, "scores").select(F.posexplode("scores").alias("component", "x"))
    variances = F.array(*[F.lit(float(v)) for v in first.variances])
    spread = scores.groupBy("component").agg(F.var_pop("x").alias("v"))
    apart = spread.select(F.abs(F.col("v") - F.get(variances, F.col("component"))).alias("x")).agg(F.max("x").alias("value"))
    v = whole.variances
    found = {
        "variances": v.sum(), "variances squared": (v**2).sum(), "variances cubed": (v**3).sum(),
        "worst remainder": max(whole.residual, first.residual),
        "worst difference of the first 50": np.abs(v[:50] - first.variances).max(),
    }
    out = spark.createDataFrame([(k, float(x)) for k, x in found.items()], "measure string, value double")
    return M.rounded(out.unionByName(apart.select(F.lit("worst difference to the variance of scores").alias("measure"), "value")), 5, "value")


@query("map_2d")
def map_2d(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    mapped = learn.map_2d(rows, "embedding")
    return mapped.select(
        "vec_id", "label", F.round(F.col("map")[0], 5).alias("x"), F.round(F.col("map")[1], 5).alias("y")
    )


def _spots(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), A.doubles(F.col("embedding")).alias("vec"), "label")


@query(
    "nearest_neighbours",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
       p AS (SELECT a.id, b.id AS neighbour, list_distance(a.e, b.e) AS distance,
                    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS rank
             FROM v a, v b WHERE a.id <> b.id)
       SELECT id, neighbour, rank::INT AS rank, round(distance, 6) + 0.0 AS distance FROM p WHERE rank <= 5""",
)
def nearest_neighbours(spark, sf_dir):
    spots = _spots(spark, sf_dir).select("id", "vec", F.lit(0).alias("grp"))
    return M.rounded(neighbours.nearest(spots, spots, 5), 6, "distance")


@query(
    "knn_accuracy",
    f"""WITH {FOLDS_SQL}, v AS (SELECT vec_id AS id, f.label, fold, embedding::DOUBLE[] AS e FROM embeddings JOIN folds f USING (vec_id)),
       p AS (SELECT a.id, a.label, a.fold, b.label AS vote,
                    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS rank
             FROM v a, v b WHERE a.fold <> b.fold),
       n AS (SELECT id, label, fold, vote, count(*) AS n FROM p WHERE rank <= 5 GROUP BY ALL),
       w AS (SELECT id, label, fold, arg_max(vote, n * 1000 - vote) AS pred FROM n GROUP BY ALL),
       f AS (SELECT fold, avg(CASE WHEN label = pred THEN 1 ELSE 0 END) AS acc FROM w GROUP BY fold)
       SELECT round(avg(acc), 6) AS knn_accuracy FROM f""",
)
def knn_accuracy(spark, sf_dir):
    spots = splits.stratified_folds(_spots(spark, sf_dir), "id", "label")
    votes = neighbours.knn_predictions(spots)
    out = M.fold_summary(votes, "fold", "label", "pred").select(F.col("accuracy").alias("knn_accuracy"))
    return M.rounded(out, 6, "knn_accuracy")


@query(
    "trustworthiness",
    """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS h, (embedding::DOUBLE[])[1:2] AS l FROM embeddings),
       p AS (SELECT a.id, b.id AS j, list_distance(a.h, b.h) AS dh,
                    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.l, b.l), b.id) AS near
             FROM v a, v b WHERE a.id <> b.id),
       r AS (SELECT id, j, near, rank() OVER (PARTITION BY id ORDER BY dh) AS far FROM p),
       n AS (SELECT count(*) AS n FROM embeddings)
       SELECT round(1 - 2.0 / (any_value(n) * 5 * (2 * any_value(n) - 16)) * sum(greatest(far - 5, 0)), 6) AS trustworthiness
       FROM r, n WHERE near <= 5""",
)
def trustworthiness(spark, sf_dir):
    """The first two elements serve as the map."""
    points = _spots(spark, sf_dir).select("id", F.col("vec").alias("high"), F.slice("vec", 1, 2).alias("low"))
    return M.rounded(neighbours.trustworthiness(points), 6, "trustworthiness")


@query("map_study")
def map_study(spark, sf_dir):
    """All map metrics on the principal-component map of the vectors."""
    mapped = learn.map_2d(_spots(spark, sf_dir), "vec", out="low")
    return M.rounded(learn.study(mapped, "id", "label", "vec", "low"), 6, "value")


def _document_features(spark, sf_dir):
    """Features of the labelled documents, taken before the join, so that no text is shuffled."""
    words = F.size(F.split("text", " "))
    features = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.log1p("n_chars").alias("chars_log"),
        F.log1p(words).alias("words_log"),
        (F.col("n_chars") / words).alias("word_size"),
        F.log1p(F.regexp_count("text", F.lit("[0-9]"))).alias("digits_log"),
    )
    return features.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("group_study")
def group_study(spark, sf_dir):
    """Map metrics per group of document features, labelled by quality."""
    rows = _document_features(spark, sf_dir)
    groups = {"size": ("chars_log", "words_log"), "style": ("word_size", "digits_log"), "missing": ("none",)}
    return M.rounded(learn.group_study(rows, "doc_id", "quality", groups), 6, "value")


@query(
    "page_type_study",
    """WITH v AS (SELECT vec_id // 5 AS company, (['about', 'ir', 'news', 'top', 'recruit'])[(vec_id * vec_id) % 5 + 1] AS page_type, label, embedding FROM embeddings),
       y AS (SELECT company, min(label) AS label FROM v GROUP BY company),
       d AS (SELECT company, page_type, dim, avg(x) AS x FROM (SELECT company, page_type, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS dim FROM v) GROUP BY ALL),
       g AS (SELECT company, label, page_type, dim, coalesce(x, 0.0) AS x FROM y CROSS JOIN (SELECT unnest(['about', 'ir', 'news', 'top']) AS page_type)
             CROSS JOIN (SELECT unnest(range(64)) AS dim) LEFT JOIN d USING (company, page_type, dim)),
       e AS MATERIALIZED (SELECT company, label, page_type, list(x ORDER BY dim) AS e FROM g GROUP BY ALL),
       p AS (SELECT a.page_type, a.company, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e) ** 2) AS s, count(*) AS n
             FROM e a JOIN e b USING (page_type) WHERE a.company <> b.company GROUP BY ALL),
       q AS (SELECT page_type, company, coalesce(sum(CASE WHEN own = other THEN s / n END), -1) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p GROUP BY ALL),
       mu AS (SELECT page_type, label, dim, avg(x) AS m, count(*) AS n FROM g GROUP BY ALL),
       mid AS (SELECT page_type, dim, avg(x) AS m FROM g GROUP BY ALL),
       bt AS (SELECT page_type, sum(mu.n * (mu.m - mid.m) ** 2) AS b FROM mu JOIN mid USING (page_type, dim) GROUP BY page_type),
       wt AS (SELECT page_type, sum((x - m) ** 2) AS w FROM g JOIN mu USING (page_type, label, dim) GROUP BY page_type),
       c AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM y)
       SELECT page_type, 'companies' AS metric, count(*)::DOUBLE AS value FROM e GROUP BY page_type
       UNION ALL SELECT page_type, 'with_page', count(*) FILTER (list_dot_product(e, e) > 0)::DOUBLE FROM e GROUP BY page_type
       UNION ALL SELECT page_type, 'silhouette', round(avg(CASE WHEN a < 0 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 FROM q GROUP BY page_type
       UNION ALL SELECT page_type, 'calinski_harabasz', round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 FROM bt JOIN wt USING (page_type), c""",
)
def page_type_study(spark, sf_dir):
    """Cluster metrics of the vectors of each page type; five vectors make a company, and some lack a type."""
    rows = _pages_of_vectors(spark, sf_dir)
    wide = vectors.category_vectors(rows, "company", "category", "vector", POOL_CATEGORIES, SIZE)
    labels = rows.groupBy("company").agg(F.min("label").alias("label"))
    return M.rounded(learn.page_type_study(wide.join(labels, "company"), "company", "label", maps=False), 6, "value")


# ------------------------------------------------------------------ encoding, training, scoring
HASH_SIZE = 16


EMBED_SQL = rf"""
c AS (SELECT source, lang, doc_id, i, 'passage: ' || substring(text, (i * 400 + 1)::BIGINT, 400) AS t
      FROM documents, unnest(range(0, (length(text) + 399) // 400)) AS r(i)),
w AS (SELECT source, lang, doc_id, i, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM c),
b AS (SELECT source, lang, doc_id, i, ('0x' || substring(md5(word), 1, 7))::BIGINT % {HASH_SIZE} AS dim, count(*) AS n FROM w GROUP BY ALL),
u AS (SELECT source, lang, doc_id, i, dim, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, i)) AS x FROM b),
chunks AS (SELECT source, lang, count(*) AS chunks FROM c GROUP BY ALL),
m AS (SELECT source, lang, dim, sum(x) AS x FROM u GROUP BY ALL),
g AS (SELECT source, lang, chunks, dim FROM chunks, (SELECT unnest(range({HASH_SIZE})) AS dim)),
pooled AS (SELECT source, lang, dim::INT AS dim, coalesce(x, 0) / chunks AS x FROM g LEFT JOIN m USING (source, lang, dim))
"""


@query("batch_embed", f"WITH {EMBED_SQL} SELECT source, lang, dim, round(x, 6) + 0.0 AS x FROM pooled")
def batch_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text")
    pooled = vectors.embed_records(docs, "source", "lang", "text", vectors.hashing_encoder(HASH_SIZE), HASH_SIZE)
    return M.rounded(pooled.select("source", "lang", F.posexplode("vector").alias("dim", "x")), 6, "x")


def _weights(size: int) -> dict:
    """Small layers, so that the SQL can spell the network out."""
    return vectors.seeded_weights(size, len(CATEGORY_IDS), len(REVENUE_IDS), embed_size=4, hidden=6)


def _fusion_sql(size: int, vector: str, category_id: str) -> str:
    """List of class probabilities of the seeded network as a SQL expression over two columns."""
    w = _weights(size)
    category = np.maximum(w["cat_e"] @ w["cat_w"].T + w["cat_b"], 0.0)
    fused = [
        f"greatest(list_dot_product({vector}, {row.tolist()}::DOUBLE[]) + {float(b)!r}, 0)"
        for row, b in zip(w["text_w"], w["text_b"])
    ] + [f"({column.tolist()}::DOUBLE[])[{category_id} + 1]" for column in category.T]
    logits = [
        f"list_dot_product([{', '.join(fused)}], {row.tolist()}::DOUBLE[]) + {float(b)!r}"
        for row, b in zip(w["out_w"], w["out_b"])
    ]
    return f"list_transform([{', '.join(logits)}], lambda z: exp(z))"


def _page_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    names = F.array(*[F.lit(c) for c in sorted(CATEGORY_IDS)])
    category = F.get(names, (F.col("vec_id") % 8).cast("int"))
    return rows.select("vec_id", category.alias("category"), A.doubles(F.col("embedding")).alias("vector")).withColumn(
        "category_id", encode_with(F.col("category"), CATEGORY_IDS)
    )


@query(
    "fusion_score",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 8 AS k FROM embeddings),
        e AS (SELECT vec_id, {_fusion_sql(SIZE, 'v', 'k')} AS e FROM v),
        p AS (SELECT vec_id, unnest(range(5)) AS class_id, unnest(e) / list_sum(e) AS p FROM e)
        SELECT vec_id, class_id::INT AS class_id, round(p, 6) AS p FROM p""",
)
def fusion_score(spark, sf_dir):
    """Class probabilities per page from the seeded fusion classifier."""
    scored = vectors.score_pages(_page_vectors(spark, sf_dir), "vector", "category_id", _weights(SIZE))
    return scored.select("vec_id", F.posexplode("probs").alias("class_id", "p")).withColumn("p", F.round("p", 6))


@query(
    "company_score",
    f"""WITH {EMBED_SQL},
        pages AS (SELECT source, lang, list(x ORDER BY dim) AS v, CASE lang WHEN 'en' THEN 7 WHEN 'fr' THEN 0 ELSE 3 END AS k
                  FROM pooled WHERE lang IN ('en', 'fr', 'de') GROUP BY source, lang),
        e AS (SELECT source, {_fusion_sql(HASH_SIZE, 'v', 'k')} AS e FROM pages),
        p AS (SELECT source, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
        s AS (SELECT source, count(*) AS n_pages, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4]), avg(p[5])] AS p FROM p GROUP BY source)
        SELECT source AS company, n_pages, ['A', 'B', 'C', 'D', 'S'][list_position(p, list_max(p))] AS estimated_class,
               round(list_max(p), 4) AS confidence, round(p[5], 4) AS p_s, 'ok' AS status FROM s""",
)
def company_score(spark, sf_dir):
    """Documents to chunks, vectors, pages, fusion classifier and company estimate. Spanish pages
    have no known category and are skipped; a company without usable page would keep a row."""
    docs = table(spark, sf_dir, "documents")
    category = F.when(F.col("lang") == "en", "top").when(F.col("lang") == "fr", "about").when(F.col("lang") == "de", "ir")
    routed = docs.select(F.col("source").alias("company"), category.alias("category"), "text")
    pages = vectors.usable_pages(routed, "text", "category")
    encoder = vectors.hashing_encoder(HASH_SIZE)
    pooled = vectors.embed_records(pages, "company", "category", "text", encoder, HASH_SIZE)
    ready = pooled.withColumn("category_id", encode_with(F.col("category"), CATEGORY_IDS))
    scored = vectors.score_pages(ready, "vector", "category_id", _weights(HASH_SIZE))
    out = vectors.company_scores(scored, "company", "probs", REVENUE_IDS, companies=routed)
    return out.select(
        "company", "n_pages", "estimated_class", "confidence", F.col("class_probabilities")["S"].alias("p_s"), "status"
    )


SECTION_CATEGORIES = {"en": "top", "fr": "about", "de": "ir", "es": "news"}
EST_W1, EST_B1, EST_W2, EST_B2 = _wave(4, HASH_SIZE, 0.4), [0.1, -0.1, 0.2, 0.0], [2.0, -1.5, 1.0, 0.5], 0.25
_EST_LOGIT = " + ".join(f"{w2} * tanh(list_dot_product(v, {w1}::DOUBLE[]) + {b1})" for w1, b1, w2 in zip(EST_W1, EST_B1, EST_W2))


@query(
    "page_estimate",
    rf"""WITH {PAGE_TEXT_SQL},
        p AS (SELECT page_id, {HOST} AS host, CASE {SECTION} WHEN 'en' THEN 'top' WHEN 'fr' THEN 'about' WHEN 'de' THEN 'ir' WHEN 'es' THEN 'news' END AS category, text
              FROM page_text),
        seen AS (SELECT host, count(*) AS pages_crawled FROM p GROUP BY host),
        budgeted AS (
          SELECT host, category, list_reduce(list_prepend('', list(substring(text, 1, 5000) ORDER BY page_id)),
            lambda acc, x: CASE WHEN length(acc) < 5000 THEN acc || ' ' || x ELSE acc END) AS text
          FROM p WHERE length(text) > 50 GROUP BY host, category),
        found AS (SELECT host, string_agg(category, ',' ORDER BY category) AS found_categories, sum(length(text))::BIGINT AS text_length_total
                  FROM budgeted GROUP BY host),
        c AS (SELECT host, category, i, 'passage: ' || substring(text, (i * 400 + 1)::BIGINT, 400) AS t
              FROM budgeted, unnest(range(0, least(8, (length(text) + 399) // 400))) AS r(i) WHERE category IS NOT NULL),
        w AS (SELECT host, category, i, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]{{2,}}')) AS word FROM c),
        b AS (SELECT host, category, i, ('0x' || substring(md5(word), 1, 7))::BIGINT % {HASH_SIZE} AS dim, count(*) AS n FROM w GROUP BY ALL),
        u AS (SELECT host, category, i, dim, n / sqrt(sum(n * n) OVER (PARTITION BY host, category, i)) AS x FROM b),
        v AS (SELECT host, category, i, [{", ".join(f"coalesce(sum(x) FILTER (dim = {d}), 0)::DOUBLE" for d in range(HASH_SIZE))}] AS v FROM u GROUP BY ALL),
        a AS (SELECT *, exp({_EST_LOGIT} + {EST_B2}) AS e FROM v),
        pooled AS (SELECT host, category, [{", ".join(f"sum(e * v[{d + 1}]) / sum(e)" for d in range(HASH_SIZE))}] AS v,
                          CASE category WHEN 'top' THEN 7 WHEN 'about' THEN 0 WHEN 'ir' THEN 3 ELSE 4 END AS k FROM a GROUP BY host, category),
        f AS (SELECT host, {_fusion_sql(HASH_SIZE, 'v', 'k')} AS e FROM pooled),
        q AS (SELECT host, list_transform(e, lambda x: x / list_sum(e)) AS p FROM f),
        s AS (SELECT host, count(*) AS n_pages, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4]), avg(p[5])] AS p FROM q GROUP BY host)
        SELECT host, coalesce(n_pages, 0) AS n_pages, ['A', 'B', 'C', 'D', 'S'][list_position(p, list_max(p))] AS estimated_class,
               round(list_max(p), 4) AS confidence, round(p[5], 4) AS p_s, CASE WHEN n_pages IS NULL THEN 'no_text' ELSE 'ok' END AS status,
               pages_crawled, coalesce(found_categories, '') AS found_categories, coalesce(text_length_total, 0) AS text_length_total
        FROM seen LEFT JOIN s USING (host) LEFT JOIN found USING (host)""",
)
def page_estimate(spark, sf_dir):
    """Stored pages to company estimates with the summary of their crawl; hosts stand for companies, the first part
    of the path for the page category."""
    texts = pages.page_texts(table(spark, sf_dir, "pages"), min_chars=None)
    names = F.create_map(*[F.lit(x) for kv in SECTION_CATEGORIES.items() for x in kv])
    routed = texts.select("page_id", _host().alias("host"), F.try_element_at(names, _section()).alias("category"), "text")
    model = Estimator(
        vectors.hashing_encoder(HASH_SIZE), HASH_SIZE,
        lambda v: vectors.attention_logit(v, EST_W1, EST_B1, EST_W2, EST_B2), _weights(HASH_SIZE),
    )
    out = company_estimates(routed, "host", "category", ["page_id"], "text", model)
    return out.select(
        "host", "n_pages", "estimated_class", "confidence", F.col("class_probabilities")["S"].alias("p_s"), "status",
        "features_summary.pages_crawled", F.array_join("features_summary.found_categories", ",").alias("found_categories"),
        "features_summary.text_length_total",
    )


@query("select_classifier")
def select_classifier(spark, sf_dir):
    """Regularisation strengths by company accuracy over company-disjoint folds; five vectors stand for a company's pages."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("company"), "label", "embedding")
    chosen = learn.select_classifier(rows, "company", "label", "embedding", max_iter=20)
    shown = M.fold_accuracy(chosen.held_out, ["candidate"], "company", "label", "probs")
    return M.rounded(chosen.candidates.join(shown, "candidate"), 6, "accuracy", "held_out_accuracy")


@query("train_classifier")
def train_classifier(spark, sf_dir):
    """Best of three regularisation strengths by validation accuracy on a stratified split."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    split = splits.split_companies(rows, "vec_id", by="label")
    train, held = split.filter(~F.col("is_test")), split.filter("is_test")
    model, _ = learn.fit_best(train, held, "embedding", learn.logistic_grid(max_iter=20))
    scored = learn.classify(held, "embedding", model)
    return M.rounded(M.classification_report(scored, "label", "pred"), 4, "precision", "recall", "f1")


GATE = [[0.5, -0.25, 0.1], [-0.4, 0.3, 0.2]]


@query(
    "gated_fusion",
    f"""WITH v AS (SELECT vec_id, (embedding::DOUBLE[])[1:2] AS t, (embedding::DOUBLE[])[3:5] AS f FROM embeddings)
        SELECT vec_id, round(t[1] / (1 + exp(-list_dot_product(f, {GATE[0]}::DOUBLE[]))), 6) + 0.0 AS g0,
               round(t[2] / (1 + exp(-list_dot_product(f, {GATE[1]}::DOUBLE[]))), 6) + 0.0 AS g1 FROM v""",
)
def gated_fusion(spark, sf_dir):
    v = A.doubles(F.col("embedding"))
    gate = A.gate_from(F.slice(v, 3, 3), GATE)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", A.gated(F.slice(v, 1, 2), gate).alias("g"))
    return M.rounded(rows.select("vec_id", F.col("g")[0].alias("g0"), F.col("g")[1].alias("g1")), 6, "g0", "g1")


@query(
    "late_fusion",
    """WITH d AS (SELECT source, count(*) AS docs, avg(n_chars) AS size FROM documents GROUP BY source),
       l AS (SELECT source, avg(quality) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY source)
       SELECT source, 0::INT AS dim, round(ln(1 + docs), 6) AS x FROM d
       UNION ALL SELECT source, 1, round(ln(1 + size), 6) FROM d
       UNION ALL SELECT source, 2, round(coalesce(quality, 0.0), 6) FROM d LEFT JOIN l USING (source)""",
)
def late_fusion(spark, sf_dir):
    """Two feature blocks concatenated into one vector per company."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    sizes = docs.groupBy("source").agg(F.array(F.log1p(F.count(F.lit(1))), F.log1p(F.avg("n_chars"))).alias("block_a"))
    marks = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.array(F.avg("quality")).alias("block_b"))
    both = sizes.join(marks, "source", "left").withColumn("block_b", F.coalesce("block_b", A.zeros(1)))
    fused = vectors.assembled(both, [F.col("block_a"), F.col("block_b")], "fused")
    return M.rounded(fused.select("source", F.posexplode("fused").alias("dim", "x")), 6, "x")
