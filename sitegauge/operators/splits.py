"""Leak-free splits by company: plain, stratified and k-fold.

Companies are ordered by a hash of name and seed, so a split depends on the data alone and is
the same for training and evaluation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import hash_rank, keep_first, null_safe_join


def company_labels(rows: DataFrame, company: str, label: str, order: str) -> DataFrame:
    """One row per company with its first label."""
    return keep_first(rows.select(company, label, order), [company], [order]).select(company, label)


def split_companies(
    companies: DataFrame, company: str, test_share: float = 0.2, seed: int = 42, by: str | None = None
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(test_share * n)`` companies, per label when ``by`` is given."""
    keys = [by] if by else []
    ranked = hash_rank(companies, company, keys, seed, "_rank")
    if by:
        sizes = companies.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
        ranked = null_safe_join(ranked, sizes, [by])
        n = F.col("_n")
    else:
        n = companies.agg(F.count(F.lit(1)).alias("n")).scalar()
    # Rounded before the ceiling, so that 0.2 * 15 is 3 and not 4.
    limit = F.ceil(F.round(F.lit(test_share) * n, 9))
    return ranked.withColumn("is_test", F.col("_rank") < limit).drop("_rank", "_n")


def stratified_folds(
    companies: DataFrame, company: str, label: str, folds: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: companies of each label dealt out in hash order."""
    ranked = hash_rank(companies, company, [label], seed, "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank")


def apply_split(rows: DataFrame, companies: DataFrame, company: str, column: str) -> DataFrame:
    """Attach a company-level split to page rows."""
    return rows.join(companies.select(company, column), company)
