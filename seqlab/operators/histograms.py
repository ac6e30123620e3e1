"""Length histograms and distances between them. Inputs are tiny after the first aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import MAX_LENGTH, MIN_LENGTH


def length_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, "length").agg(F.count("*").alias("n"))


def support(df: DataFrame) -> DataFrame:
    """The fixed length support."""
    return df.sparkSession.range(MIN_LENGTH, MAX_LENGTH + 1).select(F.col("id").alias("length"))


def paired_histogram(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Counts and probabilities of two groups over the whole support, zeros where a group is empty.

    One aggregate over the data; everything after it has one row per length.
    """
    counts = df.groupBy("length").agg(F.count_if(first).alias("n_p"), F.count_if(second).alias("n_q"))
    full = support(df).join(counts, "length", "left").na.fill(0, ["n_p", "n_q"])
    everything = Window.partitionBy(F.lit(1))
    prob = lambda n: F.when(F.sum(n).over(everything) > 0, F.col(n) / F.sum(n).over(everything)).otherwise(F.lit(0.0))
    return full.select("length", "n_p", "n_q", prob("n_p").alias("p"), prob("n_q").alias("q"))


def total_variation(p: Column, q: Column) -> Column:
    return F.sum(F.abs(p - q)) / 2


def js_divergence(p: Column, q: Column) -> Column:
    """Natural-log divergence; zero terms are skipped."""
    m = (p + q) / 2
    term = lambda x: F.sum(F.when(x > 0, x * F.log(x / m)).otherwise(0.0))
    return (term(p) + term(q)) / 2


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the base-2 divergence."""
    m = (p + q) / 2
    term = lambda x: F.sum(F.when(x > 0, x * F.log2(x / m)).otherwise(0.0))
    return F.sqrt(F.greatest((term(p) + term(q)) / 2, F.lit(0.0)))


def uniform_when_empty(n: Column, total: Column, size: Column) -> Column:
    return F.when(total > 0, n / total).otherwise(1.0 / size)


def mean_length(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean_length"))


def exact_capacity(counts: DataFrame) -> DataFrame:
    """How many negatives can follow the positive length shape exactly; input has n_p and n_q."""
    needed = counts.where("n_p > 0")
    total = F.sum("n_p").over(Window.partitionBy(F.lit(1)))
    ratio = needed.select((F.col("n_q") / (F.col("n_p") / total)).alias("ratio"))
    return ratio.agg(F.coalesce(F.floor(F.min("ratio")), F.lit(0)).cast("long").alias("capacity"))


def distribution_report(df: DataFrame, chosen: Column) -> DataFrame:
    """Positive, pool and chosen-negative distributions per length; ``label`` and the flag come from df."""
    positive, negative = F.col("label") == "positive", F.col("label") == "negative"
    pool = paired_histogram(df, positive, negative).select(
        "length", F.col("n_p").alias("positive_count"), F.col("p").alias("positive_probability"),
        F.col("n_q").alias("pool_count"), F.col("q").alias("pool_probability"))
    final = paired_histogram(df, negative & chosen, positive).select(
        "length", F.col("n_p").alias("final_count"), F.col("p").alias("final_probability"))
    out = pool.join(final, "length")
    return out.withColumn("gap", F.abs(F.col("positive_probability") - F.col("final_probability")))


def limiting_lengths(hist: DataFrame, n: int = 10) -> DataFrame:
    """Lengths with too few negatives, worst first."""
    deficit = F.col("n_p") - F.least("n_p", "n_q")
    return (
        hist.withColumn("deficit", deficit).orderBy(F.col("deficit").desc(), F.col("n_p").desc(), "length").limit(n)
        .where("n_p > n_q").select("length", "n_p", "n_q", "deficit")
    )
