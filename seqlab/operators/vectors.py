"""Geometry of embedding vectors: scaling, separation and cluster indices.

Vectors explode to (class, dim, value) and aggregate map-side; the class statistics that are
joined back have classes x dims rows, independent of the number of vectors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def fit_scaler(train: DataFrame, vector: str) -> DataFrame:
    """One row with the per-dimension mean and population deviation; tiny deviations become 1."""
    dims = train.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(
        F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    fixed = dims.withColumn("sd", F.when(F.col("sd") < 1e-6, 1.0).otherwise(F.col("sd")))
    # dims rows, one per vector position
    packed = fixed.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("_s"))
    return packed.select(F.transform("_s", lambda e: e["mean"]).alias("_mean"), F.transform("_s", lambda e: e["sd"]).alias("_sd"))


def apply_scaler(df: DataFrame, vector: str, scaler: DataFrame) -> DataFrame:
    joined = df.crossJoin(F.broadcast(scaler))  # the scaler is one row
    centred = F.zip_with(F.col(vector), F.col("_mean"), lambda x, m: x.cast("double") - m)
    return joined.withColumn(vector, F.zip_with(centred, F.col("_sd"), lambda x, s: x / s)).drop("_mean", "_sd")


def squared_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector and size per class (one row per class)."""
    means = df.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    packed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_c"), F.max("n").alias("n"))
    return packed.select(label, F.transform("_c", lambda e: e["m"]).alias("centroid"), "n")


def class_scatter(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Centroid, size, mean squared and mean distance to the centroid per class."""
    centres = centroids(df, label, vector)
    joined = df.select(label, vector).join(centres, label)
    d2 = squared_distance(F.col(vector), F.col("centroid"))
    spread = joined.select(label, d2.alias("_d2")).groupBy(label).agg(F.avg("_d2").alias("within"), F.avg(F.sqrt("_d2")).alias("mean_distance"), F.sum("_d2").alias("ss"))
    return centres.join(spread, label)


def fisher_separation(scatter: DataFrame, label: str, first, second) -> DataFrame:
    """Centroid distance and Fisher ratio of two classes."""
    pick = lambda value, col: F.max_by(F.col(col), F.col(label) == value)
    wide = scatter.where(F.col(label).isin(first, second)).agg(
        pick(first, "centroid").alias("c0"), pick(second, "centroid").alias("c1"), pick(first, "within").alias("w0"), pick(second, "within").alias("w1"))
    distance = F.sqrt(squared_distance(F.col("c0"), F.col("c1")))
    return wide.select(distance.alias("centroid_distance"), "w0", "w1", (distance * distance / F.greatest(F.col("w0") + F.col("w1"), F.lit(1e-8))).alias("fisher_ratio"))


def davies_bouldin(scatter: DataFrame, label: str) -> DataFrame:
    """Mean over classes of the worst (s_i + s_j) / d_ij; one row per class goes in."""
    a = scatter.select(F.col(label).alias("i"), F.col("centroid").alias("ci"), F.col("mean_distance").alias("si"))
    b = scatter.select(F.col(label).alias("j"), F.col("centroid").alias("cj"), F.col("mean_distance").alias("sj"))
    pairs = a.join(b, F.col("i") != F.col("j"))
    ratio = (F.col("si") + F.col("sj")) / F.sqrt(squared_distance(F.col("ci"), F.col("cj")))
    return pairs.groupBy("i").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, scatter: DataFrame, label: str, vector: str) -> DataFrame:
    total = centroids(df.withColumn("_all", F.lit(1)), "_all", vector).select(F.col("centroid").alias("overall"), F.col("n").alias("rows"))
    joined = scatter.crossJoin(F.broadcast(total))  # one row on the right
    between = F.sum(F.col("n") * squared_distance(F.col("centroid"), F.col("overall")))
    out = joined.agg(between.alias("b"), F.sum("ss").alias("w"), F.count("*").alias("k"), F.max("rows").alias("rows"))
    return out.select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("rows") - F.col("k")))).alias("calinski_harabasz"))


def squared_silhouette(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, exact and linear in the rows.

    The mean squared distance from x to a class is |x|^2 - 2 x.m + q with the class mean m and the mean
    squared norm q, so no pair of rows is ever formed.
    """
    norm = lambda v: F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    sizes = df.groupBy(label).agg(F.avg(norm(F.col(vector))).alias("q"))
    classes = centroids(df, label, vector).join(sizes, label).select(F.struct(F.col(label).alias("k"), "centroid", "n", "q").alias("e"))
    packed = classes.agg(F.collect_list("e").alias("_classes"))  # one entry per class
    joined = df.crossJoin(F.broadcast(packed))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    gaps = F.transform("_classes", lambda e: F.struct(
        e["k"].alias("k"), e["n"].alias("n"), (norm(F.col(vector)) - 2 * dot(F.col(vector), e["centroid"]) + e["q"]).alias("d")))
    rows = joined.withColumn("_g", gaps)
    own = F.get(F.filter("_g", lambda e: e["k"] == F.col(label)), F.lit(0))
    inner = own["d"] * own["n"] / F.greatest(own["n"] - 1, F.lit(1))
    outer = F.array_min(F.transform(F.filter("_g", lambda e: e["k"] != F.col(label)), lambda e: e["d"]))
    value = F.when(own["n"] > 1, (outer - inner) / F.greatest(outer, inner)).otherwise(F.lit(0.0))
    return rows.select(value.alias("s")).agg(F.avg("s").alias("silhouette"))
