"""Model training and scoring on MLlib: screening grids, importances, probes, projections, ensembles.

Fits are MLlib jobs; the driver only loops over a handful of (task, group, seed) combinations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import unit_hash
from .comparison import seed_summary
from .matching import stratified_folds
from .metrics import confusion, ranking_metrics, threshold_metrics

# Boosting settings.
TREES, LEARNING_RATE, SUBSAMPLE, DEPTH = 300, 0.05, 0.9, 5


def boosted_trees(seed: int, trees: int = TREES, depth: int = DEPTH) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, stepSize=LEARNING_RATE, maxDepth=depth, subsamplingRate=SUBSAMPLE, seed=seed)


def random_forest(seed: int, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)


def perceptron(seed: int, width: int, hidden: Sequence[int] = (32,), rounds: int = 100) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label", layers=[width, *hidden, 2], maxIter=rounds, seed=seed)


def from_array(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def from_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def hashed_split(df: DataFrame, key: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    u = unit_hash(seed, "split", F.col(key))
    return df.withColumn("split", F.when(u < train, "train").when(u < train + val, "val").otherwise("test"))


def predict(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    scored = model.transform(df)
    return scored.select(*keep, vector_to_array("probability")[1].alias("prob"))


def evaluate(predictions: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    values = threshold_metrics(confusion(predictions, by, F.col("prob") >= threshold))
    return values.join(ranking_metrics(predictions, by, bounds=()).select(*by, "roc_auc", "pr_auc"), list(by))


def screening_grid(groups: dict[str, DataFrame], make, seeds: Sequence[int]) -> DataFrame:
    """Train on 'train', evaluate on the other splits, for every group and seed; summary sorted by ROC."""
    scored = None
    for name, df in groups.items():
        data = df.cache()
        for seed in seeds:
            model = make(seed).fit(data.where("split = 'train'"))
            part = predict(model, data.where("split <> 'train'"), ["split", "label"]).withColumn("feature_group", F.lit(name)).withColumn("seed", F.lit(seed))
            scored = part if scored is None else scored.unionByName(part)
    rows = evaluate(scored, ["feature_group", "seed", "split"])
    return seed_summary(rows, ["feature_group", "split"], ["roc_auc", "pr_auc"]).orderBy("split", F.col("mean_roc_auc").desc())


def importances(model, spark, names: Sequence[str]) -> DataFrame:
    """Feature importances as rows; one value per feature of the model."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, gain double")


def topk_sweep(df: DataFrame, ranked: Sequence[str], sizes: Sequence[int], make, seed: int) -> DataFrame:
    """Validation metrics of models on the first k ranked features."""
    scored = None
    for k in sorted({min(s, len(ranked)) for s in sizes}):
        data = from_columns(df, ranked[:k])
        model = make(seed).fit(data.where("split = 'train'"))
        part = predict(model, data.where("split = 'val'"), ["label"]).withColumn("k", F.lit(k))
        scored = part if scored is None else scored.unionByName(part)
    return evaluate(scored, ["k"]).select("k", F.col("roc_auc").alias("roc"), F.col("pr_auc").alias("pr"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights rows / (classes * class size)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    weights = sizes.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / F.col("_k") / F.col("_n")).alias("weight"))  # one row on the right
    return df.join(weights, label)


def linear_probe(df: DataFrame, key: str, seed: int, folds: int = 5) -> DataFrame:
    """Out-of-fold probabilities of a balanced logistic regression on 'features'."""
    placed = class_weights(stratified_folds(df, "label", folds, seed, key)).cache()
    out = None
    for fold in range(folds):
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100).fit(placed.where(F.col("fold") != fold))
        part = predict(model, placed.where(F.col("fold") == fold), [key, "label"])
        out = part if out is None else out.unionByName(part)
    return out


def project_2d(df: DataFrame, key: str) -> DataFrame:
    """First two principal components, sign-normalised by the largest loading of each."""
    model = PCA(k=2, inputCol="features", outputCol="_pc").fit(df)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(2)]
    points = model.transform(df).select("*", vector_to_array("_pc").alias("_p"))
    return points.select(key, (F.col("_p")[0] * signs[0]).alias("x"), (F.col("_p")[1] * signs[1]).alias("y"))


def ensemble_scores(models: dict[int, object], df: DataFrame, key: str) -> DataFrame:
    """Long per-seed probabilities of stored models on one candidate table."""
    out = None
    for seed, model in models.items():
        part = predict(model, df, [key]).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out
