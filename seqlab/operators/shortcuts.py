"""Profiles of sequence shortcuts (first residue, cysteine content) per class and data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import char_frequency, count_chars


def with_shortcut_columns(df: DataFrame, seq: str = "sequence") -> DataFrame:
    s = F.col(seq)
    return df.select(
        "*", F.startswith(s, F.lit("M")).alias("starts_m"), count_chars(s, "C").alias("c_count"),
        F.contains(s, F.lit("C")).alias("contains_c"), char_frequency(s, "C").alias("c_frequency"))


def shortcut_profile(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long form (metric, value, n, count) per group."""
    flag = lambda k: F.col(k).cast("int")
    wide = with_shortcut_columns(df).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(flag("starts_m")).alias("sum_m"), F.sum(flag("contains_c")).alias("sum_has_c"),
        F.avg("c_frequency").alias("avg_freq"), F.sum("c_count").alias("sum_c"))
    entry = lambda name, value, count: F.struct(
        F.lit(name).alias("metric"), value.alias("value"), count.cast("double").alias("count"))
    rows = F.array(
        entry("starts_with_M_proportion", F.col("sum_m") / F.col("n"), F.col("sum_m")),
        entry("contains_C_proportion", F.col("sum_has_c") / F.col("n"), F.col("sum_has_c")),
        entry("mean_C_frequency", F.col("avg_freq"), F.col("sum_c")),
        entry("mean_C_count", F.col("sum_c") / F.col("n"), F.col("sum_c")))
    return wide.select(*by, "n", F.explode(rows).alias("r")).select(*by, "n", "r.metric", "r.value", "r.count")


def bias_statistics(df: DataFrame, dataset: str) -> DataFrame:
    """Shortcut rates per named data set; empty sequences do not count."""
    return with_shortcut_columns(df.where("sequence <> ''")).groupBy(dataset).agg(
        F.count("*").alias("n"), F.avg(F.col("starts_m").cast("int")).alias("m_start_rate"),
        F.avg(F.col("contains_c").cast("int")).alias("contains_c_rate"), F.avg("c_frequency").alias("mean_c_frequency"))


def pair_deltas(stats: DataFrame, dataset: str, pairs: Sequence[tuple[str, str]], values: Sequence[str]) -> DataFrame:
    """Positive minus negative for each (positive, negative) pair of data sets."""
    spec = stats.sparkSession.createDataFrame(list(pairs), ["positive_set", "negative_set"])
    side = lambda name: stats.select(F.col(dataset).alias(f"{name}_set"), *[F.col(v).alias(f"{name}_{v}") for v in values])
    joined = F.broadcast(spec).join(side("positive"), "positive_set").join(side("negative"), "negative_set")
    return joined.select("*", *[(F.col(f"positive_{v}") - F.col(f"negative_{v}")).alias(f"delta_{v}") for v in values])
