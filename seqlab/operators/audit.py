"""Group audits of generated sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def group_audit(df: DataFrame, group: str, seq: str, oracle: str, means: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Rates and means per generator group, with the share of distinct sequences and of strong scores."""
    return df.groupBy(group).agg(
        F.count("*").alias("n"), (F.count_distinct(seq) / F.count("*")).alias("unique_rate"),
        *[F.avg(m).alias(f"mean_{m}") for m in means], *[F.avg(F.col(f).cast("int")).alias(f"{f}_rate") for f in flags],
        F.avg((F.col(oracle) >= 0.9).cast("int")).alias("oracle_ge_0_9_rate"))


def uniqueness(df: DataFrame, group: str, value: str, score: str) -> DataFrame:
    return df.groupBy(group).agg((F.count_distinct(value) / F.count("*")).alias("uniqueness"), F.avg(score).alias("mean_score"))
