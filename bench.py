"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_QUERIES`` (comma-separated names, default the headline set, ``all`` for every query).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from sitegauge.plans.catalogue import CATALOGUE
from sitegauge.session import local_session

HEADLINE = (
    "page_text_summary",
    "link_categorise",
    "crawl_summary",
    "chunk_stats",
    "ordered_concat",
    "first_k_chunks",
    "budget_accumulate",
    "structural_features",
    "structural_features_default",
    "revenue_bucket",
    "two_hop_lookup",
    "tfidf_vocab",
    "tfidf_by_company",
    "mean_pool",
    "attention_pool",
    "ensemble_argmax",
    "strat_split",
    "classification_report",
    "kde_by_class",
    "silhouette",
    "calinski_harabasz",
    "batch_embed",
    "company_score",
    "stream_score",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(CATALOGUE) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # One small job first, so that no query pays for starting the session.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOGUE[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
