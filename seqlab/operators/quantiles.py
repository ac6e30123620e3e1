"""Exact quantiles from distributed cumulative counts.

Equal values collapse map-side, the value axis is cut into even slices, and only the slices that hold a
wanted order statistic are sorted. No group is gathered in one task, however many rows it owns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, shuffle_width


def slice_bounds(counts: DataFrame, slices: int | None = None) -> dict[str, list[float]]:
    """Approximate quantiles of the distinct values per metric; any bounds give exact results."""
    n = slices or shuffle_width(counts)
    if n < 2:
        return {}
    points = [i / n for i in range(1, n)]
    found = counts.groupBy("metric").agg(F.percentile_approx("value", points, 1000).alias("cuts")).collect()  # one row per column
    return {row.metric: sorted(set(row.cuts)) for row in found}


def exact_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], points: Sequence[float],
                    slices: int | None = None) -> DataFrame:
    """Linearly interpolated quantiles: ``*by, metric, i, value``, ``i`` counting ``points`` from 0.

    Nulls are left out and NaN sorts last. A group without any value of a column has no rows for it.
    Null group keys form a group. ``by`` must not use the names ``metric``, ``value`` and ``i``.
    """
    long = df.select(*by, *[F.col(k).cast("double").alias(k) for k in columns]).unpivot(list(by), list(columns), "metric", "value")
    # written once: bounds, slice totals and rows all start from the same counts
    counts = materialise(long.where("value IS NOT NULL").groupBy(*by, "metric", "value").agg(F.count("*").alias("_n")))
    counts = counts.withColumn("_slice", _slice_of(slice_bounds(counts, slices)))
    keys = [*by, "metric", "_slice"]

    group = Window.partitionBy(*by, "metric")
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_in")).select(
        *keys, "_in", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"), F.sum("_in").over(group).alias("_all"))
    wanted = F.filter(_positions(points), lambda w: (w["pos"] >= F.col("_before")) & (w["pos"] < F.col("_before") + F.col("_in")))
    needed = totals.withColumn("_want", wanted).where(F.size("_want") > 0).select(
        *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], "_before", "_want")

    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)])
    inside = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.join(needed, same).withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    held = F.filter("_want", lambda w: (w["pos"] >= F.col("_from")) & (w["pos"] < F.col("_from") + F.col("_n")))
    hits = placed.select(*by, "metric", "value", F.explode(held).alias("w"))
    side = lambda upper: F.max(F.when(F.col("w.upper") == upper, F.col("value")))
    ends = hits.groupBy(*by, "metric", F.col("w.i").alias("i")).agg(
        side(False).alias("lo"), side(True).alias("hi"), F.max("w.share").alias("share"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share"))
    return ends.select(*by, "metric", "i", value.alias("value"))


def quantile_columns(df: DataFrame, by: Sequence[str], wanted: dict[str, tuple[str, float]], slices: int | None = None) -> DataFrame:
    """One row per group and one column per name of ``wanted``, each a ``(column, point)`` pair."""
    columns = list(dict.fromkeys(k for k, _ in wanted.values()))
    points = sorted({p for _, p in wanted.values()})
    found = exact_quantiles(df, by, columns, points, slices)
    pick = lambda k, p: F.max(F.when((F.col("metric") == k) & (F.col("i") == points.index(p)), F.col("value")))
    return found.groupBy(*by).agg(*[pick(k, p).alias(name) for name, (k, p) in wanted.items()])


def with_quantiles(summary: DataFrame, quantiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach quantile columns to a per-group summary; null keys match, groups without values keep nulls."""
    right = quantiles.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(by)], *[k for k in quantiles.columns if k not in by])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(by)])
    return summary.join(right, same, "left").drop(*[f"_k{j}" for j in range(len(by))])


def _slice_of(bounds: dict[str, list[float]]) -> Column:
    """Number of bounds below the value."""
    found = F.lit(0)
    for name, cuts in bounds.items():
        table = F.array(*[F.lit(float(b)) for b in cuts]) if cuts else F.array().cast("array<double>")
        found = F.when(F.col("metric") == name, F.size(F.filter(table, lambda b: b < F.col("value")))).otherwise(found)
    return found


def _positions(points: Sequence[float]) -> Column:
    """Both neighbours of every point among ``_all`` sorted values, counted from 0."""
    out = []
    for i, p in enumerate(points):
        place = (F.col("_all") - 1) * F.lit(float(p))
        share = (place - F.floor(place)).alias("share")
        for upper in (False, True):
            near = F.ceil(place) if upper else F.floor(place)
            out.append(F.struct(F.lit(i).alias("i"), F.lit(upper).alias("upper"), near.cast("long").alias("pos"), share))
    return F.array(*out)
