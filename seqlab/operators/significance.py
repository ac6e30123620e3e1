"""Significance of one target model against comparators, from predictions on the same rows.

Every row belongs to one joint cell: its group, its label and the decision of every model. All tables follow from
the cells' row counts, their bootstrap weights and their swapped rows per replicate, so each row is hashed once per
test for all models and metrics together. There are at most 2 ** (models + 1) cells per group.
Group keys must not be null; labels are 0 or 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .metrics import THRESHOLD_METRICS, confusion, threshold_metrics
from .resampling import bootstrap_weights, interval, swap_counts, with_mcnemar_p


class Comparison:
    """Joint decisions of several models; ``probs`` maps model names to probability columns, the target first."""

    def __init__(self, df: DataFrame, by: Sequence[str], key: str, probs: Mapping[str, str], threshold: float = 0.5,
                 replicates: int = 200, seed: int = 42):
        if len(probs) < 2:
            raise ValueError("a target and at least one comparator are needed")
        self.by, self.key, self.replicates, self.seed = list(by), key, replicates, seed
        self.models = list(probs)
        self.target, *self.others = self.models
        self.cell = [*self.by, "label", *[f"hit_{m}" for m in self.models]]
        hits = [(F.col(p) >= threshold).alias(f"hit_{m}") for m, p in probs.items()]
        self.rows = df.select(*self.by, key, "label", *hits)
        self.counts = self.rows.groupBy(*self.cell).agg(F.count("*").alias("w"))

    def values(self) -> DataFrame:
        """(by, model, metric, value) on all rows."""
        return self._per_model(self.counts, self.by)

    def bootstrap(self) -> DataFrame:
        """(by, replicate, model, metric, value); all models share a replicate's weights."""
        return self._per_model(bootstrap_weights(self.rows, self.cell, self.key, self.replicates, self.seed), [*self.by, "replicate"])

    def intervals(self) -> DataFrame:
        """(by, model, metric, value, low, high)."""
        keys = [*self.by, "model", "metric"]
        return self.values().join(interval(self.bootstrap(), keys, "value"), keys)

    def comparisons(self) -> DataFrame:
        """One row per comparator and metric: both values, delta, its interval, bootstrap and permutation p."""
        keys = [*self.by, "comparator", "metric"]
        seen = self._pairs(self.values(), self.by)
        deltas = self._pairs(self.bootstrap(), [*self.by, "replicate"])
        drawn = deltas.groupBy(*keys).agg(
            F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"),
            F.count_if(F.col("delta") <= 0).alias("_lost"), F.count("delta").alias("_n"))
        swapped = self._swapped_deltas().join(seen.select(*keys, F.col("delta").alias("_seen")), keys).groupBy(*keys).agg(
            F.count_if(F.col("delta") >= F.col("_seen") - 1e-12).alias("_above"), F.count("delta").alias("_swaps"))
        gained = lambda hits, n: F.when(F.col("delta") <= 0, 1.0).otherwise((F.col(hits) + 1) / (F.col(n) + 1))
        return seen.join(drawn, keys).join(swapped, keys).select(
            *keys, "target_value", "comparator_value", "delta", "low", "high",
            gained("_lost", "_n").alias("bootstrap_p"), gained("_above", "_swaps").alias("permutation_p"))

    def best_comparisons(self) -> DataFrame:
        """The rows of ``comparisons`` for the best comparator of each metric; the first named one wins ties."""
        place = F.array_position(F.array(*[F.lit(m) for m in self.others]), F.col("model"))
        best = self.values().where(F.col("model") != self.target).groupBy(*self.by, "metric").agg(
            F.max_by("model", F.struct("value", -place)).alias("comparator"))
        return self.comparisons().join(best, [*self.by, "metric", "comparator"], "left_semi")

    def mcnemar(self) -> DataFrame:
        """(by, comparator, a_only, b_only, p_value): rows that only the target, only the comparator decides rightly."""
        pairs = self._pair_cells(self.counts, [])
        right = lambda k: F.col(k).cast("int") == F.col("label")
        only = lambda x, y: F.coalesce(F.sum(F.when(right(x) & ~right(y), F.col("w"))), F.lit(0))
        return with_mcnemar_p(pairs.groupBy(*self.by, "comparator").agg(
            only("target_hit", "other_hit").alias("a_only"), only("other_hit", "target_hit").alias("b_only")))

    def _per_model(self, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
        sides = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"hit_{m}").alias("hit")) for m in self.models])
        long = cells.select(*keys, "label", "w", F.inline(sides))
        return _metric_rows(long, [*keys, "model"])

    def _pairs(self, values: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, comparator, metric, target_value, comparator_value, delta)."""
        of = lambda m: F.max(F.when(F.col("model") == m, F.col("value"))).alias(f"of_{m}")
        wide = values.groupBy(*keys, "metric").agg(*[of(m) for m in self.models])
        sides = F.array(*[F.struct(F.lit(m).alias("comparator"), F.col(f"of_{m}").alias("comparator_value")) for m in self.others])
        return wide.select(*keys, "metric", F.col(f"of_{self.target}").alias("target_value"), F.inline(sides)).withColumn(
            "delta", F.col("target_value") - F.col("comparator_value"))

    def _pair_cells(self, cells: DataFrame, extra: Sequence[str]) -> DataFrame:
        """Cells of the target and one comparator: (by, extra, comparator, label, target_hit, other_hit, w)."""
        sides = F.array(*[F.struct(F.lit(m).alias("comparator"), F.col(f"hit_{m}").alias("other_hit")) for m in self.others])
        long = cells.select(*self.by, *extra, "label", "w", F.col(f"hit_{self.target}").alias("target_hit"), F.inline(sides))
        return long.groupBy(*self.by, *extra, "comparator", "label", "target_hit", "other_hit").agg(F.sum("w").alias("w"))

    def _swapped_deltas(self) -> DataFrame:
        """(by, comparator, metric, replicate, delta) after target and comparator change places in the swapped rows."""
        cell = [*self.by, "comparator", "label", "target_hit", "other_hit"]
        moved = self._pair_cells(swap_counts(self.rows, self.cell, self.key, self.replicates, self.seed), ["replicate"])
        sizes = self._pair_cells(self.counts, []).withColumnRenamed("w", "n")
        kept = F.col("n") - F.col("w")
        part = lambda side, hit, w: F.struct(F.lit(side).alias("side"), F.col(hit).alias("hit"), w.alias("v"))
        parts = F.array(part("a", "target_hit", kept), part("a", "other_hit", F.col("w")),
                        part("b", "other_hit", kept), part("b", "target_hit", F.col("w")))
        keys = [*self.by, "comparator", "replicate"]
        long = moved.join(sizes, cell).select(*keys, "label", F.inline(parts)).withColumnRenamed("v", "w")
        of = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
        return _metric_rows(long, [*keys, "side"]).groupBy(*keys, "metric").agg((of("a") - of("b")).alias("delta"))


def _metric_rows(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    values = threshold_metrics(confusion(long, keys, F.col("hit"), F.col("w")))
    return values.unpivot(list(keys), list(THRESHOLD_METRICS), "metric", "value")
