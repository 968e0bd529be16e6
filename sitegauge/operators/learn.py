"""Scaling, projection and classifier fitting; fitted parameters are small, rows stay put."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions.rules import FEATURE_CATEGORIES, FEATURE_GROUPS
from ..session import cut_lineage
from .companies import page_vector, present_columns
from .metrics import calinski_harabasz, company_accuracy, company_predictions, fold_summary, silhouette
from .neighbours import knn_predictions, trustworthiness
from .splits import stratified_folds


@dataclass(frozen=True)
class Scaler:
    """Means and population standard deviations, one number per element."""

    means: tuple[float, ...]
    stds: tuple[float, ...]

    def transform(self, rows: DataFrame, vector: str, out: str | None = None) -> DataFrame:
        """z-scores; a constant element becomes 0. A map over the rows, no shuffle."""
        means = F.array(*[F.lit(m) for m in self.means])
        scales = F.array(*[F.lit(1.0 / s if s > 0 else 0.0) for s in self.stds])
        centred = F.zip_with(A.doubles(F.col(vector)), means, lambda x, m: x - m)
        return rows.withColumn(out or vector, F.zip_with(centred, scales, lambda x, s: x * s))


def fit_scaler(rows: DataFrame, vector: str) -> Scaler:
    """One aggregate over the rows; only the two parameter vectors reach the driver."""
    v = array_to_vector(A.doubles(F.col(vector)))
    s = rows.agg(Summarizer.metrics("count", "mean", "variance").summary(v).alias("s")).select("s.*").first()
    n = s["count"]
    shrink = (n - 1) / n if n > 1 else 0.0
    stds = []
    for mean, variance in zip(s["mean"], s["variance"]):
        std = (variance * shrink) ** 0.5
        # Rounding noise of a constant element is not spread.
        stds.append(0.0 if std <= 1e-12 * max(1.0, abs(mean)) else std)
    return Scaler(tuple(float(m) for m in s["mean"]), tuple(stds))


def vectorised(rows: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Columns as one array, missing values as 0."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    return rows.withColumn(out, F.array(*values))


@dataclass(frozen=True)
class Components:
    """Principal components: means, directions (a column each, largest first), population variances along them, and the
    largest remainder ``|C v - variance v|`` as a share of the first variance."""

    means: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    residual: float


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def covariance_product(rows: DataFrame, vector: str, means: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """``C · basis`` for the population covariance ``C``, without forming ``C``: each task adds up ``X' (X basis)``."""
    size, width = basis.shape

    def partial(batches):
        total = np.zeros((size, width))
        for batch in batches:
            x = _matrix(batch["v"].drop_null(), size) - means
            total += x.T @ (x @ basis)
        columns = [pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "g"])

    parts = rows.select(A.doubles(F.col(vector)).alias("v")).mapInArrow(partial, "dim int, g array<double>")
    sums = parts.groupBy("dim").agg(F.array(*[F.sum(F.get("g", F.lit(i))) for i in range(width)]).alias("g")).collect()
    out = np.zeros((size, width))
    for r in sums:
        out[r["dim"]] = r["g"]
    return out / n


def fit_pca(
    rows: DataFrame, vector: str, k: int = 50, extra: int = 10, tolerance: float = 1e-9, most_passes: int = 60, seed: int = 42
) -> Components:
    """The ``k`` largest principal components (``k`` is cut to the vector length), by randomised subspace iteration.

    Every pass multiplies the covariance with a block of ``k + extra`` directions in one distributed product; the
    products so far span the space in which the components are sought (block Krylov), until their remainder is below
    ``tolerance``. The driver holds matrices of vector length times at most eight blocks, never the covariance. The
    largest loading of each direction is positive. Rows without a vector are left out.
    """
    rows = rows.filter(F.col(vector).isNotNull())
    scaler = fit_scaler(rows, vector)
    means, n = np.array(scaler.means), rows.count()
    size = len(means)
    k, width = min(k, size), min(k + extra, size)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(most_passes):
        image = covariance_product(rows, vector, means, block, n)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, inner = values[order], inner[:, order]
        found, moved = basis @ inner[:, :k], images @ inner[:, :k]
        top = max(values[0], np.finfo(float).tiny)
        rest = moved - found * values[:k]
        residual = float(np.linalg.norm(rest, axis=0).max() / top)
        if residual <= tolerance or basis.shape[1] == size:
            break
        if basis.shape[1] + width > 8 * width:  # start anew from the best directions so far
            keep = inner[:, :width]
            basis, images = basis @ keep, images @ keep
            image = images - basis @ (basis.T @ images)
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        left, strength, _ = np.linalg.svd(image, full_matrices=False)
        block = left[:, strength > 1e-13 * top][:, : size - basis.shape[1]]
        if not block.shape[1]:
            break
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(k)])
    return Components(means, found * np.where(signs == 0, 1.0, signs), np.maximum(values[:k], 0.0), residual)


def project(rows: DataFrame, vector: str, fitted: Components, out: str) -> DataFrame:
    """Component scores, in Arrow batches; null where there is no vector."""
    size = len(fitted.means)
    rows = rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def scores(batches):
        for batch in batches:
            there = batch["_v"].is_valid()
            values = pa.array(((_matrix(batch["_v"].drop_null(), size) - fitted.means) @ fitted.directions).tolist(), pa.list_(pa.float64()))
            places = np.where(there, np.cumsum(there) - 1, 0)
            column = values.take(pa.array(places, mask=~np.asarray(there))) if len(values) else pa.nulls(batch.num_rows, values.type)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_v"]).columns, column], names=schema.names)

    return rows.withColumn("_v", A.doubles(F.col(vector))).mapInArrow(scores, schema)


def map_2d(rows: DataFrame, vector: str, components: int = 50, seed: int = 42, out: str = "map") -> DataFrame:
    """Two coordinates per row for maps: the first two components, or value and jitter for one column."""
    size = rows.select(F.max(F.size(vector))).first()[0]
    if size == 1:
        jitter = F.randn(seed) * 0.1
        return rows.withColumn(out, F.array(F.get(F.col(vector), F.lit(0)).cast("double"), jitter))
    scores = project(rows, vector, fit_pca(rows, vector, components), "_scores")
    return scores.withColumn(out, F.slice("_scores", 1, 2)).drop("_scores")


def study(rows: DataFrame, key: str, label: str, high: str, low: str, k: int = 5, folds: int = 5) -> DataFrame:
    """Silhouette, Calinski-Harabasz, neighbour accuracy and trustworthiness of a map, as one row."""
    rows = cut_lineage(rows.select(key, label, high, low), "map")
    spots = cut_lineage(stratified_folds(rows.select(key, label, low), key, label, folds), "folds")
    votes = knn_predictions(
        spots.select(F.col(key).alias("id"), F.col(low).alias("vec"), F.col(label).alias("label"), "fold"), k, folds
    )
    parts = [
        silhouette(rows, label, low).select("silhouette"),
        calinski_harabasz(rows, label, low).select("calinski_harabasz"),
        fold_summary(votes, "fold", "label", "pred").select(F.col("accuracy").alias("knn_accuracy")),
        trustworthiness(rows.select(F.col(key).alias("id"), F.col(high).alias("high"), F.col(low).alias("low")), k),
    ]
    long = [p.select(F.lit(p.columns[0]).alias("metric"), F.col(p.columns[0]).alias("value")) for p in parts]
    out = long[0]
    for p in long[1:]:
        out = out.unionByName(p)
    return out


def group_study(rows: DataFrame, key: str, label: str, groups: dict[str, tuple[str, ...]] = FEATURE_GROUPS) -> DataFrame:
    """The map metrics for every named group of columns that exists."""
    used = list(dict.fromkeys(c for wanted in groups.values() for c in present_columns(rows, wanted)))
    table = cut_lineage(rows.select(key, label, *used), "features")
    out: DataFrame | None = None
    for name, wanted in groups.items():
        columns = present_columns(rows, wanted)
        if not columns:
            continue
        packed = vectorised(table.select(key, label, *columns), columns, "high").select(key, label, "high")
        scaled = fit_scaler(packed, "high").transform(packed, "high")
        mapped = map_2d(scaled, "high", out="low")
        part = study(mapped, key, label, "high", "low").select(F.lit(name).alias("feature_group"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no feature group has a column in the table")
    return out


def page_type_study(rows: DataFrame, key: str, label: str, page_types: tuple[str, ...] = FEATURE_CATEGORIES, maps: bool = True) -> DataFrame:
    """``page_type, metric, value`` for every page type whose vectors the table has, missing vectors as zeros.

    How many companies there are and have a page, the cluster metrics of the vectors and, with ``maps``, of their
    two-dimensional map.
    """
    chosen = {page: vector for page in page_types if (vector := page_vector(rows, page)) is not None}
    if not chosen:
        raise ValueError("no page type has vectors in the table")
    table = cut_lineage(rows.select(key, label, *[v.alias(f"{p}_vec") for p, v in chosen.items()]), "page-vectors")
    out: DataFrame | None = None
    for page in chosen:
        own = table.select(key, label, F.col(f"{page}_vec").alias("high"))
        size = own.agg(F.max(F.size("high"))).first()[0] or 1
        own = own.withColumn("high", F.coalesce("high", A.zeros(size)))
        there = F.when(A.dot(F.col("high"), F.col("high")) > 0, 1)
        counts = own.agg(F.count(F.lit(1)).cast("double").alias("companies"), F.count(there).cast("double").alias("with_page"))
        parts = [
            counts.select(F.lit("companies").alias("metric"), F.col("companies").alias("value")),
            counts.select(F.lit("with_page").alias("metric"), F.col("with_page").alias("value")),
            silhouette(own, label, "high").select(F.lit("silhouette").alias("metric"), F.col("silhouette").alias("value")),
            calinski_harabasz(own, label, "high").select(F.lit("calinski_harabasz").alias("metric"), F.col("calinski_harabasz").alias("value")),
        ]
        if maps:
            mapped = study(map_2d(own, "high", out="low"), key, label, "high", "low")
            parts.append(mapped.select(F.concat(F.lit("map_"), "metric").alias("metric"), "value"))
        for part in parts:
            named = part.select(F.lit(page).alias("page_type"), "metric", "value")
            out = named if out is None else out.unionByName(named)
    return out


# ------------------------------------------------------------------ classifier
def balanced_weights(rows: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``n / (classes * n_class)`` per row."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    weighted = sizes.select(label, (totals["n"] / (totals["k"] * F.col("_n"))).alias(out))
    return rows.join(weighted, label)


def logistic_grid(reg_params: tuple[float, ...] = (0.0, 0.01, 0.1), max_iter: int = 50) -> list:
    return [
        LogisticRegression(
            featuresCol="_x", labelCol="label", weightCol="weight", predictionCol="pred", regParam=r, maxIter=max_iter
        )
        for r in reg_params
    ]


def perceptron(layers: list[int], seed: int = 42, max_iter: int = 50) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol="_x", labelCol="label", predictionCol="pred", layers=layers, seed=seed, maxIter=max_iter
    )


def as_features(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("_x", array_to_vector(A.doubles(F.col(vector))))


def fit_best(
    train: DataFrame, validation: DataFrame, vector: str, estimators: list, company: str | None = None
) -> tuple[PipelineModel, float]:
    """The candidate with the best validation accuracy; the first one wins ties.

    With ``company`` given a company counts once, with the mean of its pages' probabilities.
    """
    ready = as_features(balanced_weights(train, "label"), vector).persist()
    held = as_features(validation, vector).persist()
    best: tuple[PipelineModel, float] | None = None
    try:
        for estimator in estimators:
            model = Pipeline(stages=[estimator]).fit(ready)
            judged = model.transform(held)
            if company:
                judged = company_predictions(judged.withColumn("_p", vector_to_array("probability")), company, "label", "_p")
            hit = (F.col("pred") == F.col("label")).cast("int")
            score = judged.agg(F.avg(hit)).first()[0] or 0.0
            if best is None or score > best[1]:
                best = (model, score)
    finally:
        ready.unpersist()
        held.unpersist()
    return best


class CompanyAccuracy(Evaluator):
    """Share of companies whose pages' mean probabilities are largest for the company's label."""

    def __init__(self, company: str, label: str = "label", probability: str = "probability"):
        super().__init__()
        self.company, self.label, self.probability = company, label, probability

    def _evaluate(self, dataset: DataFrame) -> float:
        pages = dataset.withColumn("_p", vector_to_array(self.probability))
        return company_accuracy(pages, self.company, self.label, "_p").first()["accuracy"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


@dataclass(frozen=True)
class Selection:
    """The chosen model fitted on all rows, what each candidate reached, and the probabilities that show it.

    ``candidates``: candidate, reg_param, accuracy (mean over folds). ``held_out``: candidate, fold, company, label,
    probs for every page, from the model that did not see its company; a written table.
    """

    model: CrossValidatorModel
    candidates: DataFrame
    held_out: DataFrame


def select_classifier(
    pages: DataFrame, company: str, label: str, vector: str, reg_params: tuple[float, ...] = (0.0, 0.01, 0.1),
    folds: int = 5, max_iter: int = 50, seed: int = 42,
) -> Selection:
    """Regularisation by cross-validated company accuracy; all pages of a company are in one fold.

    A company's label is the smallest of its pages' labels, and its pages are trained on that one.
    """
    labels = pages.groupBy(company).agg(F.min(label).cast("double").alias("label"))
    dealt = cut_lineage(stratified_folds(labels, company, "label", folds, seed), "folds")
    rows = pages.select(company, vector).join(dealt, company)
    ready = cut_lineage(balanced_weights(rows, "label").select(company, "fold", "label", "weight", A.doubles(F.col(vector)).alias("_v")), "train")
    ready = ready.withColumn("_x", array_to_vector("_v")).drop("_v")
    learner = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="weight", predictionCol="pred", maxIter=max_iter)
    grid = ParamGridBuilder().addGrid(learner.regParam, list(reg_params)).build()
    search = CrossValidator(
        estimator=learner, estimatorParamMaps=grid, evaluator=CompanyAccuracy(company), numFolds=folds, foldCol="fold", collectSubModels=True
    )
    model = search.fit(ready)
    held: DataFrame | None = None
    for fold, tried in enumerate(model.subModels):
        unseen = ready.filter(F.col("fold") == fold)
        for number, sub in enumerate(tried):
            scored = sub.transform(unseen).select(
                F.lit(number).alias("candidate"), "fold", company, "label", vector_to_array("probability").alias("probs")
            )
            held = scored if held is None else held.unionByName(scored)
    tried = [(i, float(r), float(a)) for i, (r, a) in enumerate(zip(reg_params, model.avgMetrics, strict=True))]
    candidates = pages.sparkSession.createDataFrame(tried, "candidate int, reg_param double, accuracy double")
    return Selection(model, candidates, cut_lineage(held, "held-out"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify(rows: DataFrame, vector: str, model: PipelineModel, out: str = "probs") -> DataFrame:
    """Predicted label and class probabilities."""
    scored = model.transform(as_features(rows, vector))
    return scored.withColumn(out, vector_to_array("probability")).drop("_x", "rawPrediction", "probability")
