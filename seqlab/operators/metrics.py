"""Binary evaluation metrics over long prediction tables (group columns, label, prob).

Everything starts from counts per distinct score, which combine map-side, so tied scores and hot
groups collapse before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import safe_ratio
from ..session import materialise, shuffle_width
from .quantiles import exact_quantiles

THRESHOLD_METRICS = ("sensitivity", "specificity", "precision", "npv", "accuracy", "balanced_accuracy", "f1", "mcc")


def confusion(df: DataFrame, by: Sequence[str], predicted: Column, weight: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn per group; weighted when a weight column is given."""
    one = F.lit(1).cast("long") if weight is None else weight
    cell = lambda cond: F.coalesce(F.sum(F.when(cond, one)), F.lit(0))
    yes = F.col("label") == 1
    return df.groupBy(*by).agg(
        cell(yes & predicted).alias("tp"), cell(~yes & predicted).alias("fp"),
        cell(~yes & ~predicted).alias("tn"), cell(yes & ~predicted).alias("fn"))


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """Metrics from confusion counts; a zero denominator gives zero."""
    tp, fp, tn, fn = (F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))
    sensitivity, specificity = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    product = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(
        "*", sensitivity.alias("sensitivity"), specificity.alias("specificity"), safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tn, tn + fn).alias("npv"), safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ((sensitivity + specificity) / 2).alias("balanced_accuracy"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_ratio(tp * tn - fp * fn, product).alias("mcc"))


def score_counts(df: DataFrame, by: Sequence[str], score: str = "prob", weight: Column | None = None) -> DataFrame:
    """Positives and negatives per group and distinct score."""
    one = F.lit(1).cast("long") if weight is None else weight
    return df.groupBy(*by, score).agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, one)), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, one)), F.lit(0)).alias("neg"))


def _sliced(counts: DataFrame, score: str, bounds: Sequence[float]) -> DataFrame:
    table = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    return counts.withColumn("_slice", F.size(F.filter(table, lambda b: b < F.col(score))))


def score_bounds(df: DataFrame, score: str = "prob", slices: int | None = None) -> list[float]:
    """Approximate quantiles that cut the score axis into even slices; any bounds give exact results."""
    n = slices or shuffle_width(df)
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(score, [i / n for i in range(1, n)], 1000)).first()[0]
    return sorted(set(found or []))


def cumulative_counts(counts: DataFrame, by: Sequence[str], score: str, bounds: Sequence[float]) -> DataFrame:
    """Positives and negatives with a strictly higher score (``tp_above``, ``fp_above``) per distinct score.

    Sums run inside score slices, then the totals of higher slices are added, so that one huge group
    is not sorted in one task.
    """
    sliced = _sliced(counts, score, bounds)
    inside = Window.partitionBy(*by, "_slice").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select(
        "*", F.coalesce(F.sum("pos").over(inside), F.lit(0)).alias("_p"), F.coalesce(F.sum("neg").over(inside), F.lit(0)).alias("_n"))
    totals = sliced.groupBy(*by, "_slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    higher = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_slice", F.coalesce(F.sum("sp").over(higher), F.lit(0)).alias("_op"), F.coalesce(F.sum("sn").over(higher), F.lit(0)).alias("_on"))
    joined = local.join(offsets, [*by, "_slice"])
    return joined.select(
        *by, score, "pos", "neg", (F.col("_p") + F.col("_op")).alias("tp_above"), (F.col("_n") + F.col("_on")).alias("fp_above"))


def ranking_metrics(df: DataFrame, by: Sequence[str], score: str = "prob", weight: Column | None = None,
                    bounds: Sequence[float] | None = None) -> DataFrame:
    """ROC-AUC with ties counted half, and step-wise average precision, per group."""
    if bounds is None:
        bounds = score_bounds(df, score)
    cum = cumulative_counts(score_counts(df, by, score, weight), by, score, bounds)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    above, false_above = F.col("tp_above").cast("double"), F.col("fp_above").cast("double")
    # a negative at this score loses to every positive above and draws with the positives here
    wins = F.sum(neg * (above + pos / 2))
    precision = safe_ratio(above + pos, above + pos + false_above + neg)
    out = cum.groupBy(*by).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), wins.alias("_wins"), F.sum(pos * precision).alias("_ap"))
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return out.select(
        *by, "positives", "negatives", F.when((p > 0) & (n > 0), F.col("_wins") / p / n).alias("roc_auc"), safe_ratio(F.col("_ap"), p).alias("pr_auc"))


def best_thresholds(df: DataFrame, by: Sequence[str], score: str = "prob") -> DataFrame:
    """Threshold with the best balanced accuracy among 97 score quantiles; the smallest wins ties, 0.5 when empty.

    The quantiles are exact and come from counts per slice. Counting at a threshold needs the counts per distinct score only.
    """
    points = [0.02 + 0.01 * i for i in range(97)]
    found = exact_quantiles(df, by, [score], [round(p, 2) for p in points])
    grid = materialise(found.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("_grid")))  # used twice; one short row per group
    counts = score_counts(df, by, score)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    # one row per (group, threshold) below its score: a slice index per score, then a running total
    placed = counts.join(grid, list(by)).withColumn("_i", F.size(F.filter("_grid", lambda t: t <= F.col(score))))
    cells = placed.groupBy(*by, "_i").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    wide = grid.select(*by, F.posexplode("_grid").alias("_k", "threshold")).join(totals, list(by))
    hit = wide.join(cells, list(by)).where(F.col("_i") > F.col("_k")).groupBy(*by, "threshold", "all_pos", "all_neg").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp"))
    score_value = (safe_ratio(F.col("tp"), F.col("all_pos")) + safe_ratio(F.col("all_neg") - F.col("fp"), F.col("all_neg"))) / 2
    scored = hit.withColumn("balanced", F.round(score_value * 1e12) / 1e12)
    best = scored.groupBy(*by).agg(F.max_by("threshold", F.struct("balanced", -F.col("threshold"))).alias("threshold"), F.max("balanced").alias("balanced_accuracy"))
    return best.withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def log_loss(df: DataFrame, by: Sequence[str], logit: Column) -> DataFrame:
    """Mean binary cross entropy of logits in the form that cannot overflow."""
    y = F.col("label").cast("double")
    loss = F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"))


def seed_ensemble(df: DataFrame, keys: Sequence[str], seed: str, seeds: Sequence, prob: str = "prob") -> DataFrame:
    """Mean and population deviation of the probability per id, plus one column per seed."""
    per_seed = [F.max(F.when(F.col(seed) == s, F.col(prob))).alias(f"{prob}_seed{s}") for s in seeds]
    return df.groupBy(*keys).agg(F.avg(prob).alias("score"), F.stddev_pop(prob).alias("score_std"), *per_seed)
