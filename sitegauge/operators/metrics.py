"""Evaluation and feature-space metrics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import cut_lineage
from . import pairs
from .ranking import null_safe_join
from .vectors import mean_vector


LEAST_PROBABILITY = 1e-15


# ------------------------------------------------------------------ classification
def accuracy(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    hit = (F.col(label) == F.col(predicted)).cast("int")
    return rows.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def cross_entropy(rows: DataFrame, probs: str, label: str) -> DataFrame:
    """Mean of ``-ln p[label]``; a probability below ``LEAST_PROBABILITY`` counts as that, so an impossible page is not
    left out. A page without a label or without a probability for it has no loss and does not count."""
    given = F.get(F.col(probs), F.col(label).cast("int")).cast("double")
    loss = F.when(given.isNotNull() & ~F.isnan(given), -F.log(F.greatest(given, F.lit(LEAST_PROBABILITY))))
    return rows.agg(F.avg(loss).alias("cross_entropy"))


def company_predictions(pages: DataFrame, company: str, label: str, probs: str) -> DataFrame:
    """``company, label, pred, probs``: mean probabilities of a company's pages, and the class of the largest.

    The label is that of any of its pages, the smallest if they differ.
    """
    means = pages.groupBy(company).agg(F.min(label).alias("label"), mean_vector(A.doubles(F.col(probs))).alias("probs"))
    return means.select(company, "label", A.argmax(F.col("probs")).alias("pred"), "probs")


def company_accuracy(pages: DataFrame, company: str, label: str, probs: str) -> DataFrame:
    """Share of companies whose mean probabilities are largest for their label."""
    return accuracy(company_predictions(pages, company, label, probs), "label", "pred")


def fold_accuracy(held_out: DataFrame, keys: list[str], company: str, label: str, probs: str, fold: str = "fold") -> DataFrame:
    """``held_out_accuracy`` per key: company accuracy in each fold, averaged over the folds; and ``companies``."""
    judged = held_out.groupBy(*keys, fold, company).agg(F.min(label).alias("_y"), mean_vector(A.doubles(F.col(probs))).alias("_p"))
    hit = (A.argmax(F.col("_p")) == F.col("_y")).cast("int")
    folds = judged.groupBy(*keys, fold).agg(F.avg(hit).alias("_a"), F.count(F.lit(1)).alias("_n"))
    return folds.groupBy(*keys).agg(F.avg("_a").alias("held_out_accuracy"), F.sum("_n").alias("companies"))


def confusion_counts(rows: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Long confusion matrix ``true, pred, n``."""
    keys = by or []
    return rows.groupBy(*keys, F.col(label).alias("true"), F.col(predicted).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(rows: DataFrame, label: str, predicted: str, classes: list) -> DataFrame:
    """One row per true class, one count column ``pred_{class}`` each, zeros included."""
    counts = confusion_counts(rows, label, predicted)
    cells = [
        F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(F.lit(0))).alias(f"pred_{c}") for c in classes
    ]
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("true"))
    found = counts.groupBy("true").agg(*cells)
    return grid.join(found, "true", "left").na.fill(0)


def classification_report(
    rows: DataFrame, label: str, predicted: str, by: list[str] | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted averages.

    Rows are counted once per (true, predicted) pair; everything after works on those counts.
    Undefined ratios are 0.
    """
    keys = by or []
    counts = confusion_counts(rows, label, predicted, by)
    sides = F.explode(
        F.array(
            F.struct(F.col("true").alias("cls"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("prd")),
            F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("prd")),
        )
    )
    hit = F.when((F.col("true") == F.col("pred")) & (F.col("s.sup") > 0), F.col("n")).otherwise(F.lit(0))
    per = (
        counts.withColumn("s", sides)
        .groupBy(*keys, F.col("s.cls").cast("string").alias("class"))
        .agg(F.sum(hit).alias("tp"), F.sum("s.sup").alias("support"), F.sum("s.prd").alias("predicted"))
    )
    zero = F.lit(0.0)
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(zero)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(zero)
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("predicted") + F.col("support"))).otherwise(zero)
    scored = per.select(
        *keys, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "tp"
    )
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    summary = scored.groupBy(*keys).agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in measures],
        (F.sum("tp") / total).alias("acc"),
        total.alias("support"),
    )
    lines = F.explode(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[F.col("acc").alias(m) for m in measures]),
            F.struct(F.lit("macro avg").alias("class"), *[F.col(f"macro_{m}").alias(m) for m in measures]),
            F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{m}").alias(m) for m in measures]),
        )
    )
    averages = summary.select(*keys, lines.alias("l"), "support").select(
        *keys, "l.class", *[f"l.{m}" for m in measures], "support"
    )
    return scored.drop("tp").unionByName(averages)


def fold_summary(rows: DataFrame, fold: str, label: str, predicted: str) -> DataFrame:
    """Accuracy and macro-F1 averaged over folds."""
    report = classification_report(rows, label, predicted, [fold])
    return report.agg(
        F.avg(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
        F.avg(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("macro_f1"),
        F.count_distinct(fold).alias("folds"),
    )


def class_distribution(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label)


# ------------------------------------------------------------------ distributions
def density_by_class(
    rows: DataFrame, label: str, value: str, points: int = 200, cut: float = 3.0, bins: int | None = None
) -> DataFrame:
    """Gaussian density estimate per class, each normalised alone: ``label, point_no, x, density``.

    Bandwidth ``h`` by Scott's rule (sample standard deviation times ``n^(-1/5)``); the grid of a
    class runs ``cut`` bandwidths beyond its range. Every value has its kernel; equal ones are counted
    first. With ``bins`` values are shared linearly between the two nearest of so many grid lines a
    bandwidth instead, and an estimate is off by at most ``0.4 / (8 * bins^2 * h)``, the error of
    interpolating the kernel between two lines. Classes of equal values have no density.
    """
    seen = rows.filter(F.col(value).isNotNull()).select(F.col(label).alias("_l"), F.col(value).cast("double").alias("_v"))
    widths = (
        seen.groupBy("_l")
        .agg(
            F.count("_v").alias("_n"),
            F.stddev_samp("_v").alias("_sd"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
        )
        .filter((F.col("_n") > 1) & (F.col("_sd") > 0))
        .withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    )
    if bins is None:
        counted = seen.groupBy("_l", "_v").agg(F.count(F.lit(1)).alias("_a"))
    else:
        place = (F.col("_v") - F.col("_lo")) / (F.col("_h") / bins)
        near = null_safe_join(seen, widths.drop("_sd", "_n", "_hi"), ["_l"]).withColumn("_place", place).withColumn("_line", F.floor("_place"))
        right = F.col("_place") - F.col("_line")
        counted = near.groupBy("_l", "_line").agg(F.sum(1 - right).alias("_a"), F.sum(right).alias("_b"))
    start = F.col("_lo") - cut * F.col("_h")
    step = (F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / (points - 1)

    def kernel(i: Column, away: Column) -> Column:
        u = (start + step * i - F.col("_lo")) / F.col("_h") - away
        return F.exp(-u * u / 2)

    def share(i: Column) -> Column:
        if bins is None:
            return F.col("_a") * kernel(i, (F.col("_v") - F.col("_lo")) / F.col("_h"))
        return F.col("_a") * kernel(i, F.col("_line") / bins) + F.col("_b") * kernel(i, (F.col("_line") + 1) / bins)

    shares = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), share)
    held = null_safe_join(counted, widths.drop("_sd"), ["_l"])
    summed = held.groupBy("_l").agg(
        vector_to_array(Summarizer.sum(array_to_vector(shares))).alias("_d"), *[F.first(c).alias(c) for c in ("_n", "_lo", "_hi", "_h")]
    )
    scale = F.col("_n") * F.col("_h") * F.lit((2 * math.pi) ** 0.5)
    each = summed.select("*", F.posexplode("_d").alias("point_no", "_e"))
    return each.select(F.col("_l").alias(label), "point_no", (start + step * F.col("point_no")).alias("x"), (F.col("_e") / scale).alias("density"))


# ------------------------------------------------------------------ clusters
def centred(rows: DataFrame, vector: str) -> DataFrame:
    """Vectors less their overall mean: distances stay, and sums of squares keep their digits however far off zero they lie."""
    v = A.doubles(F.col(vector))
    middle = rows.agg(mean_vector(v).alias("m")).scalar()
    moved = F.zip_with(v, F.col("_middle"), lambda x, m: x - m)
    return rows.withColumn("_middle", middle).withColumn(vector, moved).drop("_middle")


def cluster_moments(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Size, mean and summed squared length per cluster: enough for squared-distance metrics."""
    v = A.doubles(F.col(vector))
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("size"), mean_vector(v).alias("mean"), F.sum(A.dot(v, v)).alias("squares")
    )


def calinski_harabasz(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Between-cluster over within-cluster variance; one pass over the rows.

    Rows are reduced to one line per cluster, whose number the label domain bounds. Null with a
    single cluster, or where no cluster has any width.
    """
    moments = cluster_moments(centred(rows, vector), label, vector)
    packed = moments.agg(
        F.collect_list(F.struct("size", "mean", "squares")).alias("m"),
        F.sum("size").alias("n"),
        F.count(F.lit(1)).alias("k"),
    )
    scaled = F.transform("m", lambda c: F.transform(c["mean"], lambda x: x * c["size"]))
    total = F.aggregate(F.slice(scaled, F.lit(2), F.size(scaled)), F.get(scaled, 0), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    placed = packed.withColumn("centre", F.transform(total, lambda x: x / F.col("n")))
    between = A.array_sum(F.transform("m", lambda c: c["size"] * A.squared_distance(c["mean"], F.col("centre"))))
    within = A.array_sum(F.transform("m", lambda c: c["squares"] - c["size"] * A.dot(c["mean"], c["mean"])))
    spread = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(within, F.col("n") - F.col("k")))
    return placed.select(spread.alias("calinski_harabasz"), "n", "k")


def silhouette(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, exact and linear in the rows.

    The mean squared distance of a point to a cluster follows from the cluster's size, mean and
    summed squares, so no pair of points is ever formed. Clusters travel as one small array
    (label domain), in a scalar subquery.
    """
    rows = centred(rows, vector)
    v = A.doubles(F.col(vector))
    packed = cluster_moments(rows, label, vector).agg(
        F.collect_list(F.struct(F.col(label).alias("label"), "size", "mean", "squares"))
    )
    clusters = rows.select(F.col(label).alias("_l"), v.alias("_v")).withColumn("_m", packed.scalar())
    me = A.dot(F.col("_v"), F.col("_v"))
    dist = F.transform(
        "_m",
        lambda c: F.struct(
            c["label"].alias("label"),
            c["size"].alias("size"),
            F.greatest(
                c["size"] * me + c["squares"] - 2 * c["size"] * A.dot(c["mean"], F.col("_v")), F.lit(0.0)
            ).alias("total"),
        ),
    )
    scored = clusters.select("_l", dist.alias("d"))
    own = F.get(F.filter("d", lambda c: c["label"] == F.col("_l")), 0)
    others = F.transform(F.filter("d", lambda c: c["label"] != F.col("_l")), lambda c: c["total"] / c["size"])
    both = scored.select(
        own["size"].alias("size"),
        F.try_divide(own["total"], own["size"] - 1).alias("a"),
        F.array_min(others).alias("b"),
    )
    s = F.when(F.col("size") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return both.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded doubles without negative zero."""
    return rows.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def rounded_array(values: Column, digits: int) -> Column:
    return F.transform(values, lambda x: F.round(x, digits) + F.lit(0.0))


EUCLIDEAN_BLOCK = 2_048


def silhouette_euclidean(rows: DataFrame, label: str, vector: str, block_rows: int = EUCLIDEAN_BLOCK) -> DataFrame:
    """Mean silhouette under plain Euclidean distance, over all rows.

    Mean distances have no closed form, so every point meets every other: the work grows with the
    square of the rows (``silhouette`` is linear). Points are dealt into parts that meet each other
    (``pairs``), where distances are formed for blocks of ``block_rows`` and added up for each point
    and cluster; only those sums leave the task. Only the list of cluster names, which the label
    domain bounds, reaches the driver. Rows without a vector are left out, a null label is a cluster
    of its own.
    """
    name = F.coalesce(F.concat(F.lit("+"), F.col(label).cast("string")), F.lit("-"))
    named = rows.select(name.alias("_name"), vector)
    there = centred(named.filter(F.col(vector).isNotNull()), vector)
    points = cut_lineage(there.select("_name", F.monotonically_increasing_id().alias("at"), A.doubles(F.col(vector)).alias("v")), "vectors")
    sizes = points.groupBy("_name").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).orderBy("_name").collect()
    names, counts = [r["_name"] for r in sizes], [r["n"] for r in sizes]
    k, size = len(names), max((r["d"] for r in sizes), default=1)

    def distances(asked, held):
        totals = [np.empty((0, k))]
        at, own = pairs.unpacked(asked, "at", "int64"), pairs.unpacked(asked, "own", "int64")
        if len(at) and held.num_rows:
            x, y = (pairs.unpacked(t, "v", "float64").reshape(-1, size) for t in (asked, held))
            cluster = np.eye(k)[pairs.unpacked(held, "own", "int64")]
            # A point is not apart from itself, whatever the product's rounding.
            _, here, same = np.intersect1d(at, pairs.unpacked(held, "at", "int64"), return_indices=True)
            for i in range(0, len(x), block_rows):
                totals.append(np.zeros((len(x[i : i + block_rows]), k)))
                for j in range(0, len(y), block_rows):
                    apart = pairs.squares(x[i : i + block_rows], y[j : j + block_rows])
                    met = (here >= i) & (here < i + block_rows) & (same >= j) & (same < j + block_rows)
                    apart[here[met] - i, same[met] - j] = 0.0
                    totals[-1] += np.sqrt(np.maximum(apart, 0.0, out=apart), out=apart) @ cluster[j : j + block_rows]
        sums = np.concatenate(totals)
        return pa.table({"at": at[: len(sums)], "own": own[: len(sums)], "totals": pa.array(sums.tolist(), pa.list_(pa.float64()))})

    placed = points.select("at", (F.array_position(F.lit(names), F.col("_name")) - 1).alias("own"), "v")
    n = sum(counts)
    sums = pairs.meet(
        placed, pairs.parts_for(n, size, block_rows), placed, pairs.parts_for(n, size), distances, "at long, own long, totals array<double>"
    )
    each = sums.groupBy("at").agg(F.min("own").alias("own"), F.array(*[F.sum(F.get("totals", F.lit(i))) for i in range(k)]).alias("t"))
    weights = F.array(*[F.lit(float(c)) for c in counts])
    means = F.transform(F.arrays_zip("t", weights.alias("n")), lambda z, i: F.when(i != F.col("own"), z["t"] / z["n"]))
    mine = F.get(weights, F.col("own"))
    both = each.select(mine.alias("size"), F.try_divide(F.get("t", F.col("own")), mine - 1).alias("a"), F.array_min(means).alias("b"))
    s = F.when(F.col("size") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return both.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))
