"""Summaries and comparisons of metric tables over seeds, models, tasks and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .quantiles import quantile_columns, with_quantiles


def seed_summary(results: DataFrame, by: Sequence[str], metrics: Sequence[str], seed: str = "seed", extremes: bool = False) -> DataFrame:
    """Mean and population deviation over seeds, optionally min and max, and the number of seeds."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"mean_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
        if extremes:
            out += [F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return results.groupBy(*by).agg(*out, F.count_distinct(seed).alias("n_seeds"))


def loss_curve(history: DataFrame, by: Sequence[str], losses: Sequence[str], seed: str = "seed") -> DataFrame:
    """Mean and sample deviation (0 for one seed) per epoch."""
    out = []
    for m in losses:
        out += [F.avg(m).alias(f"mean_{m}"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"std_{m}")]
    return history.groupBy(*by).agg(*out, F.count_distinct(seed).alias("n_seeds"))


def describe(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    found = quantile_columns(df, by, {"median": (value, 0.5), "p75": (value, 0.75), "p90": (value, 0.9)})
    plain = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_quantiles(plain, found, by).select(*by, "count", "mean", "median", "p75", "p90", "max")


def seed_deltas(results: DataFrame, keys: Sequence[str], target: str, other: str, metrics: Sequence[str]) -> DataFrame:
    """Target minus other per seed, one row per (keys, metric); a missing side gives null."""
    pick = lambda model, m: F.max(F.when(F.col("model") == model, F.col(m)))
    wide = results.groupBy(*keys).agg(*[(pick(target, m) - pick(other, m)).alias(m) for m in metrics])
    return wide.unpivot(list(keys), list(metrics), "metric", "delta")


def delta_statistics(deltas: DataFrame, by: Sequence[str], seed: str = "seed") -> DataFrame:
    """Mean, sample deviation, improved seeds and the per-seed text; the number of seeds is small and fixed."""
    text = F.concat(F.col(seed).cast("string"), F.lit(":"), S.fixed4(F.col("delta"), signed=True))
    listed = F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct(F.col(seed).alias("s"), text.alias("x")))))
    return deltas.groupBy(*by).agg(
        F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd_delta"), F.count_if(F.col("delta") > 0).alias("seeds_improved"),
        F.count("delta").alias("seeds_total"), F.array_join(F.transform(listed, lambda e: e["x"]), "; ").alias("seed_deltas"))


def key_gains(stats: DataFrame, minimum: float = 0.0005, wins: int = 2) -> DataFrame:
    kept = stats.where((F.col("mean_delta") > minimum) & (F.col("seeds_improved") >= wins))
    return kept.withColumn("gain", F.concat(F.lit("delta "), S.fixed4(F.col("mean_delta"), signed=True))).withColumn(
        "seed_wins", F.concat_ws("/", F.col("seeds_improved").cast("string"), F.col("seeds_total").cast("string")))


def model_deltas(summary: DataFrame, keys: Sequence[str], target: str, other: str, metrics: Sequence[str]) -> DataFrame:
    """Difference of the summarised means of two models, one column per metric."""
    pick = lambda model, m: F.max(F.when(F.col("model") == model, F.col(f"mean_{m}")))
    return summary.groupBy(*keys).agg(*[(pick(target, m) - pick(other, m)).alias(m) for m in metrics])


def positive_gains(deltas: DataFrame, keys: Sequence[str], metrics: Sequence[str], minimum: float = 0.0005) -> DataFrame:
    return deltas.unpivot(list(keys), list(metrics), "metric", "gain").where(F.col("gain") > minimum)


def mark_best(df: DataFrame, by: Sequence[str], value: str, rule: str = "exact", slack: float = 0.0005) -> DataFrame:
    """Flag the best value of a group: exact maximum, close to it, or within a slack of it."""
    top = F.max(value).over(Window.partitionBy(*by))
    hit = {"exact": F.col(value) == top, "close": S.is_close(F.col(value), top), "slack": F.col(value) >= top - slack}[rule]
    return df.withColumn("is_best", hit)


def win_tie_loss(summary: DataFrame, keys: Sequence[str], target: str, other: str, directions: dict[str, str], eps: float = 0.005) -> DataFrame:
    """Status of target against other per metric, with the metric's direction and a tie band."""
    pick = lambda model, m: F.max(F.when(F.col("model") == model, F.col(f"mean_{m}")))
    entries = []
    for m, direction in directions.items():
        sign = 1.0 if direction == "higher" else -1.0
        entries.append(F.struct(
            F.lit(m).alias("metric"), F.lit(direction).alias("direction"), pick(target, m).alias("target_mean"), pick(other, m).alias("other_mean"),
            ((pick(target, m) - pick(other, m)) * sign).alias("beneficial_delta")))
    wide = summary.groupBy(*keys).agg(F.array(*entries).alias("e"))
    rows = wide.select(*keys, F.explode("e").alias("e")).select(*keys, "e.*")
    rows = rows.where("target_mean IS NOT NULL AND other_mean IS NOT NULL")
    delta = F.col("beneficial_delta")
    return rows.withColumn("status", F.when(F.abs(delta) <= eps, "tie").when(delta > 0, "win").otherwise("loss"))


def best_other(long: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """Target value next to the best value of any other model, per group."""
    others = F.when(F.col("model") != target, F.col("value"))
    return long.groupBy(*by).agg(
        F.max(F.when(F.col("model") == target, F.col("value"))).alias("target_value"), F.max(others).alias("best_other"),
        F.max_by(F.col("model"), F.struct(others.isNotNull(), others, F.col("model"))).alias("best_other_model")).withColumn(
            "delta", F.col("target_value") - F.col("best_other"))


def pivot_metric(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.first(value))


def lookup_values(long: DataFrame, spec: Sequence[tuple], keys: Sequence[str]) -> DataFrame:
    """Values for a fixed list of keys; an absent key raises inside the job."""
    table = long.sparkSession.createDataFrame([tuple(k) for k in spec], list(keys))
    joined = F.broadcast(table).join(long, list(keys), "left")
    missing = F.raise_error(F.concat(F.lit("no value for "), F.to_json(F.struct(*keys)))).cast("double")
    return joined.select(*keys, F.when(F.col("value").isNull(), missing).otherwise(F.col("value")).alias("value"))


DUAL_METRICS = ("sensitivity", "specificity", "accuracy", "precision", "roc_auc", "pr_auc", "f1", "mcc")


def dual_rows(left: DataFrame, right: DataFrame, category: str) -> DataFrame:
    """Every model of the first task with every model of the second, macro means and worst task.

    Both sides are metric tables with one row per model, so the product is bounded.
    """
    a = left.select(F.col("model").alias("_ma"), *[F.col(m).alias(f"a_{m}") for m in DUAL_METRICS])
    b = right.select(F.col("model").alias("_mb"), *[F.col(m).alias(f"b_{m}") for m in DUAL_METRICS])
    joined = a.crossJoin(F.broadcast(b)).withColumn("model", F.concat_ws(" + ", "_ma", "_mb")).withColumn("category", F.lit(category))
    return joined.select(
        "model", "category", *[f"a_{m}" for m in DUAL_METRICS], *[f"b_{m}" for m in DUAL_METRICS],
        *[((F.col(f"a_{m}") + F.col(f"b_{m}")) / 2).alias(f"macro_{m}") for m in DUAL_METRICS],
        *[F.least(f"a_{m}", f"b_{m}").alias(f"worst_task_{m}") for m in ("roc_auc", "pr_auc")])


def select_groups(summary: DataFrame, quantile: float, floor_roc: float, floor_pr: float, max_std: float) -> DataFrame:
    """Groups that pass max(floor, quantile) on both metrics in a task, kept for every task with flags."""
    cuts = summary.groupBy("task").agg(
        F.greatest(F.lit(floor_roc), F.percentile("mean_roc", F.lit(quantile))).alias("_roc"),
        F.greatest(F.lit(floor_pr), F.percentile("mean_pr", F.lit(quantile))).alias("_pr"))
    ok = (F.col("mean_roc") >= F.col("_roc")) & (F.col("mean_pr") >= F.col("_pr")) & (F.col("std_roc") <= max_std)
    flagged = summary.join(cuts, "task").withColumn("selected", ok).drop("_roc", "_pr")
    anywhere = F.max("selected").over(Window.partitionBy("feature_group"))
    return flagged.withColumn("_any", anywhere).where("_any").drop("_any")


def compact_topk(sweep: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """Smallest K within the tolerance of the best (ROC, then PR) row, per task."""
    best = sweep.groupBy("task").agg(F.max_by(F.struct("roc", "pr"), F.struct("roc", "pr")).alias("_b"))
    near = sweep.join(best, "task").where(
        (F.col("roc") >= F.col("_b.roc") - tolerance) & (F.col("pr") >= F.col("_b.pr") - tolerance))
    return near.groupBy("task").agg(F.min_by(F.struct("k", "roc", "pr"), F.struct("k", -F.col("roc"), -F.col("pr"))).alias("r")).select("task", "r.*")


def set_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    joined = left.join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return joined.agg(
        F.count("_a").alias("size_a"), F.count("_b").alias("size_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("size_both"), F.count("*").alias("size_any"))
