"""Models: pyspark.ml estimators, and loops whose only driver state is a few parameters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import md5
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loomframe.operators.features import fit_scaler, scale
from loomframe.operators.similarity import normalized
from loomframe.operators.window import quota
from loomframe.plans.checkpoints import materialize
from loomframe.plans.gram import product_sums
from loomframe.plans.ordered import join_stats, row_numbers

FEATURES = "features"


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="error").transform(df)


def probability(model_output: DataFrame, out: str) -> DataFrame:
    """Probability of class 1 as a plain column."""
    return model_output.withColumn(out, vector_to_array("probability")[1])


# --- k-means -----------------------------------------------------------------------------------


def unit_draw(seed: str, *parts: int) -> float:
    """Seeded number in [0, 1) for a handful of starting values."""
    text = ":".join([seed, *map(str, parts)])
    return int(md5(text.encode()).hexdigest()[:8], 16) / 2**32


def box_centers(df: DataFrame, vector: str, k: int, seed: str) -> list[list[float]]:
    """k seeded points in the bounding box of the vectors."""
    v = array_to_vector(F.col(vector))
    box = df.agg(Summarizer.min(v).alias("low"), Summarizer.max(v).alias("high")).first()
    low, high = box["low"].toArray().tolist(), box["high"].toArray().tolist()
    return [[a + unit_draw(seed, i, j) * (b - a) for j, (a, b) in enumerate(zip(low, high))] for i in range(k)]


def _nearest_sums(centers: np.ndarray):
    """Task function: number and sum of the vectors nearest to each center (the first one on ties)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centers.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, d))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                column = batch.column(0).slice(at, 4096).drop_null()
                if not len(column):
                    continue
                points = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d)
                nearest = np.stack([((points - c) ** 2).sum(axis=1) for c in centers], axis=1).argmin(axis=1)
                n += np.bincount(nearest, minlength=k)
                np.add.at(sums, nearest, points)
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n[found]), pa.array(list(sums[found]), pa.list_(pa.float64()))], ["cluster", "n", "sums"])

    return run


def lloyd_step(df: DataFrame, vector: str, centers: Sequence[Sequence[float]]) -> DataFrame:
    """(cluster, center, n): mean of the vectors nearest to each center.

    Batches of vectors meet the centers as matrices; a task passes on one row per center.
    """
    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(_nearest_sums(np.array(centers, float)), "cluster int, n long, sums array<double>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col("sums")))).alias("sums"))
    return added.select("cluster", F.transform("sums", lambda x: x / F.col("n")).alias("center"), "n")


def k_means(df: DataFrame, vector: str, k: int, seed: str, tolerance: float = 1e-3, max_rounds: int = 300) -> list[list[float]]:
    """Centers after Lloyd rounds, until their summed squared shift is at most the tolerance.

    A cluster without points keeps its center. Raises when the rounds run out before that.
    """
    points = materialize(df.select(vector).hint("rebalance"))
    centers = box_centers(points, vector, k, seed)
    for _ in range(max_rounds):
        moved = {r["cluster"]: r["center"] for r in lloyd_step(points, vector, centers).collect()}  # k rows
        fresh = [moved.get(i, c) for i, c in enumerate(centers)]
        shift = sum((a - b) ** 2 for old, new in zip(centers, fresh) for a, b in zip(old, new))
        centers = fresh
        if shift <= tolerance:
            return centers
    raise RuntimeError(f"centers still move by {shift} after {max_rounds} rounds")


# --- linear models by gradient descent ------------------------------------------------------------


def moments(df: DataFrame, columns: Sequence[str], label: str) -> tuple[list[list[float]], list[float], float, int]:
    """X'X, X'y, y'y (all divided by n) and n, with a leading bias column: one pass of matrix products.

    The rows that come back are those of a matrix with a column per feature.
    """
    one = "_one"
    every = [one, *columns, label]
    sums, _ = product_sums(df.withColumn(one, F.lit(1.0)), every, every, shift=False)
    rows = {r["i"]: (r["n"], r["sxy"]) for r in sums.select("i", "n", "sxy").collect()}
    d, n = len(columns) + 1, rows[0][0][0] if rows else 0.0
    mean = [[p / m if m else 0.0 for p, m in zip(rows[i][1], rows[i][0])] for i in range(d + 1)]
    return [row[:d] for row in mean[:d]], [row[d] for row in mean[:d]], mean[d][d], int(n)


def gradient_descent(
    df: DataFrame, columns: Sequence[str], label: str, rate: float, epochs: int, factor: float = 1.0
) -> tuple[list[float], list[float]]:
    """(theta, cost per epoch) of batch gradient descent on squared error, from zero.

    The gradient is a function of the moments, so every epoch after the one pass over the data is
    arithmetic on a d x d matrix. ``factor`` is 1 for the halved cost and 2 for the plain mean square.
    """
    xx, xy, yy, _ = moments(df, columns, label)
    d = len(xy)
    theta, costs = [0.0] * d, []
    for _ in range(epochs):
        slope = [sum(xx[i][j] * theta[j] for j in range(d)) - xy[i] for i in range(d)]
        theta = [a - rate * factor * s for a, s in zip(theta, slope)]
        quad = sum(theta[i] * xx[i][j] * theta[j] for i in range(d) for j in range(d))
        costs.append(factor / 2 * (quad - 2 * sum(a * b for a, b in zip(theta, xy)) + yy))
    return theta, costs


def linear_score(theta: Sequence[float], columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * F.lit(w) for w, c in zip(theta[1:], columns)], F.lit(theta[0]))


def linear_class(theta: Sequence[float], columns: Sequence[str]) -> Column:
    """0 below one half, else 1."""
    return F.when(linear_score(theta, columns) < 0.5, 0).otherwise(1)


def least_absolute(df: DataFrame, columns: Sequence[str], label: str, rate: float, epochs: int) -> tuple[list[float], list[float]]:
    """(theta, mean absolute error per epoch) by sign-gradient descent; one aggregation per epoch."""
    data = df.select(*columns, label).persist()
    theta, errors = [0.0] * (len(columns) + 1), []
    for _ in range(epochs):
        residual = linear_score(theta, columns) - F.col(label)
        terms = [F.lit(1.0), *[F.col(c) for c in columns]]
        row = data.agg(*[F.avg(F.signum(residual) * t) for t in terms], F.avg(F.abs(residual))).first()
        theta = [a - rate * g for a, g in zip(theta, row)]
        errors.append(row[len(theta)])
    data.unpersist()
    return theta, errors


def linear_regression(df: DataFrame, columns: Sequence[str], label: str, lasso: float = 0.0):
    """Closed-form least squares, or lasso when a penalty is given; the model carries coefficients and R2."""
    kind = {"solver": "normal"} if lasso == 0 else {"elasticNetParam": 1.0, "regParam": lasso, "tol": 1e-10, "maxIter": 500}
    return LinearRegression(featuresCol=FEATURES, labelCol=label, **kind).fit(assemble(df, columns))


def pca(df: DataFrame, columns: Sequence[str], k: int):
    """Principal components of standardised columns: (model, scaled frame with ``pca``)."""
    scaled = assemble(scale(df, fit_scaler(df, columns, "standard")), columns)
    model = PCA(k=k, inputCol=FEATURES, outputCol="pca").fit(scaled)
    return model, model.transform(scaled)


def component_signs(model) -> list[float]:
    """Sign per component that makes its first loading away from zero positive."""
    return [1.0 if next((v for v in col if abs(v) > 1e-6), 1.0) > 0 else -1.0 for col in model.pc.toArray().T.tolist()]


# --- classifiers ----------------------------------------------------------------------------------


def logistic_regression(
    n: int, label: str, c: float = 1.0, l1_ratio: float = 0.0, rounds: int = 50, tolerance: float = 1e-6
) -> LogisticRegression:
    """Penalty strength given as C of n rows, on unscaled features."""
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol=label,
        regParam=1.0 / (c * n),
        elasticNetParam=l1_ratio,
        standardization=False,
        maxIter=rounds,
        tol=tolerance,
    )


def linear_svm(label: str, c: float = 1.0, n: int = 1000, classes: int = 2, rounds: int = 50) -> Estimator:
    """Hinge loss with an L2 penalty; more than two classes are fitted one against the rest, side by side."""
    svm = LinearSVC(featuresCol=FEATURES, labelCol=label, regParam=1.0 / (c * n), maxIter=rounds)
    return svm if classes == 2 else OneVsRest(classifier=svm, featuresCol=FEATURES, labelCol=label, parallelism=4)


def fourier_features(columns: Sequence[str], gamma: float, components: int, seed: str) -> dict[str, Column]:
    """Random Fourier features of the RBF kernel (Rahimi and Recht, 2007) as a projection."""
    out = {}
    for i in range(components):
        total = F.lit(2 * math.pi * unit_draw(seed, i, -1))
        for j, c in enumerate(columns):
            radius = math.sqrt(-2 * math.log(1 - unit_draw(seed, i, 2 * j)))
            normal = radius * math.cos(2 * math.pi * unit_draw(seed, i, 2 * j + 1))
            total = total + F.col(c) * F.lit(math.sqrt(2 * gamma) * normal)
        out[f"rff_{i}"] = F.cos(total) * F.lit(math.sqrt(2 / components))
    return out


def decision_tree(label: str, depth: int = 5, seed: int = 42, bins: int = 32) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(featuresCol=FEATURES, labelCol=label, maxDepth=depth, maxBins=bins, seed=seed)


def random_forest(label: str, trees: int = 50, depth: int = 5, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol=FEATURES, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def scaled_line(columns: Sequence[str], label: str, **settings) -> Pipeline:
    """Standard scaler and linear regression as one estimator, so that a fold refits both."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol=FEATURES, withMean=True),
            LinearRegression(featuresCol=FEATURES, labelCol=label, tol=1e-10, maxIter=500, **settings),
        ]
    )


def text_classifier(text: str, classifier: Estimator, width: int = 1 << 16) -> Pipeline:
    """Words, hashed term counts, inverse document frequencies and a classifier, fitted together."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width),
            IDF(inputCol="_tf", outputCol=FEATURES),
            classifier,
        ]
    )


def fit_pipeline(df: DataFrame, columns: Sequence[str], estimator: Estimator) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol=FEATURES), estimator]).fit(df)


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def calibrated(train: DataFrame, df: DataFrame, margin: str, label: str, out: str) -> DataFrame:
    """A margin turned into a probability by a one-column logistic regression (Platt, 1999)."""
    vector = VectorAssembler(inputCols=[margin], outputCol="_margin")
    model = LogisticRegression(featuresCol="_margin", labelCol=label, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred").fit(
        vector.transform(train)
    )
    scored = model.transform(vector.transform(df))
    return scored.withColumn(out, vector_to_array("_prob")[1]).drop("_margin", "_prob", "_raw", "_pred")


def feature_importance(model: Model, columns: Sequence[str], spark) -> DataFrame:
    """(feature, importance) of a fitted tree model: one row per column."""
    rows = [(c, float(model.featureImportances[i])) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "feature string, importance double")


# --- tuning and cross-validation --------------------------------------------------------------------


def parameter_grid(estimator: Estimator, options: dict[str, Sequence]) -> list[dict]:
    names = list(options)
    return [{estimator.getParam(n): v for n, v in zip(names, values)} for values in product(*options.values())]


def random_grid(grid: Sequence[dict], draws: int, seed: str) -> list[dict]:
    """A seeded sample of grid points without repeats."""
    return sorted(grid, key=lambda p: md5((seed + ":" + repr(sorted((k.name, v) for k, v in p.items()))).encode()).hexdigest())[:draws]


def search(df: DataFrame, estimator: Estimator, grid: Sequence[dict], label: str, fold: str, k: int, evaluator: Evaluator | None = None, parallelism: int = 4) -> CrossValidatorModel:
    """Cross-validated search over given folds (by accuracy unless told otherwise); grid points run side by side."""
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=list(grid),
        evaluator=evaluator or MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=k,
        foldCol=fold,
        parallelism=parallelism,
    ).fit(df)


def out_of_fold(df: DataFrame, estimator: Estimator, fold: str, k: int) -> DataFrame:
    """Every row scored once, by the model fitted on the other folds."""
    parts = [estimator.fit(df.filter(F.col(fold) != i)).transform(df.filter(F.col(fold) == i)) for i in range(k)]
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- recommender --------------------------------------------------------------------------------------


def dense_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): numbers from 0 for the distinct values of any type, null left out."""
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return row_numbers(distinct, [column], out="_rn").select(column, (F.col("_rn") - 1).cast("int").alias(out))


def item_tag_vectors(df: DataFrame, item: str, tag: str, weight: str, rank: int = 16, rounds: int = 10, penalty: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(item vectors, tag vectors) as (key, vector) tables from implicit (item, tag, weight) links.

    Keys may be of any type; the factorisation works on dense codes. Links without a key or weight are left out.
    """
    items, tags = materialize(dense_codes(df, item, "_item")), materialize(dense_codes(df, tag, "_tag"))
    links = join_stats(join_stats(df.filter(F.col(weight).isNotNull()), items, [item]), tags, [tag])
    links = materialize(links.select("_item", "_tag", F.col(weight).cast("float").alias("_weight")))
    model = ALS(userCol="_item", itemCol="_tag", ratingCol="_weight", implicitPrefs=True, rank=rank, maxIter=rounds, regParam=penalty, seed=seed).fit(links)

    def named(factors: DataFrame, codes: DataFrame, key: str, code: str) -> DataFrame:
        vectors = factors.select(F.col("id").alias(code), F.col("features").cast("array<double>").alias("vector"))
        return codes.join(vectors, code).select(F.col(key).alias("key"), "vector")

    return named(model.userFactors, items, item, "_item"), named(model.itemFactors, tags, tag, "_tag")


def _block_tops(names: list, asked: np.ndarray, n: int):
    """Task function: the best ``n`` keys of a task for each asked vector, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = np.broadcast_to(np.array(batch.column(0).to_pylist(), object), (len(names), batch.num_rows))
            found = asked @ flat.T
            keys, scores = (own, found) if keys is None else (np.concatenate([keys, own], axis=1), np.concatenate([scores, found], axis=1))
            if scores.shape[1] > n:  # ties go to the smaller key
                order = np.stack([np.array(sorted(range(scores.shape[1]), key=lambda i: (-s[i], k[i]))[:n]) for s, k in zip(scores, keys)])
                keys, scores = np.take_along_axis(keys, order, 1), np.take_along_axis(scores, order, 1)
        if keys is not None:
            rows = [(name, k, float(s)) for q, name in enumerate(names) for k, s in zip(keys[q].tolist(), scores[q].tolist())]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["query", "key", "score"]), preserve_index=False)

    return run


def best_matches(vectors: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(query, place, key, score): the ``n`` rows of (key, vector) with the largest dot product for each (query, vector).

    ``asked`` is a list of named queries and goes to the driver; ``vectors`` may be of any length: each task keeps
    its best ``n`` per query, and these are merged. Equal scores go in order of the keys.
    """
    rows = asked.select("query", "vector").orderBy("query").collect()
    schema = StructType([StructField("query", StringType()), StructField("key", vectors.schema["key"].dataType), StructField("score", DoubleType())])
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema).select("query", F.lit(0).cast("bigint").alias("place"), "key", "score")
    table = np.array([r["vector"] for r in rows], float)
    tops = vectors.select("key", "vector").mapInArrow(_block_tops([str(r["query"]) for r in rows], table, n), schema)
    return quota(tops, ["query"], [F.desc("score"), "key"], n, "place").select("query", "place", "key", "score")


def listed_vectors(vectors: DataFrame, lists: DataFrame) -> DataFrame:
    """(query, vector): the sum of the vectors of each query's keys, from (query, key) rows, as unit vectors."""
    summed = vectors.join(lists.distinct(), "key").groupBy("query").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("vector")))).alias("vector"))
    return normalized(summed, "vector")
