"""Exact global positions and ranks without funnelling a table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise, shuffle_width


def global_position(df: DataFrame, order: Sequence[Column], column: str = "position") -> DataFrame:
    """1-based position of every row under a total order.

    Range-partition and sort, keep that result in the checkpoint folder so that both passes see
    the same slices, then add the number of rows in earlier slices. Only one row per slice is
    broadcast, so the broadcast never grows with the data. ``order`` must end in a unique key.
    """
    placed = materialise(
        df.repartitionByRange(shuffle_width(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    slice_no = F.shiftright("_mark", 33)
    sizes = placed.groupBy(slice_no.alias("_slice")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = placed.withColumn("_slice", slice_no)
    joined = placed.join(F.broadcast(offsets), "_slice")
    in_slice = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(column, (F.col("_before") + in_slice + 1).cast("long")).drop("_mark", "_slice", "_before")


def assign_ids(df: DataFrame, order: Sequence[Column], prefix: str, column: str = "fasta_id", width: int = 6) -> DataFrame:
    placed = global_position(df, order, "_position")
    text = F.col("_position").cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return placed.withColumn(column, F.concat(F.lit(f"{prefix}_"), padded)).drop("_position")


def stratum_rank(df: DataFrame, strata: Sequence[str], order_value: Column, tiebreak: Sequence[str],
                 column: str = "rank", buckets: int = 1024) -> DataFrame:
    """1-based rank inside each stratum, ascending in ``order_value`` (a number in [0, 1]).

    A stratum may hold a third of all rows, so it is cut into value buckets: rows are numbered
    inside (stratum, bucket) and the counts of earlier buckets are added. The order value is a
    hash-based draw in every caller, so the buckets are even.
    """
    keyed = df.withColumn("_value", order_value).withColumn("_bucket", F.floor(F.col("_value") * buckets).cast("int"))
    earlier = _bucket_offsets(keyed, strata)
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_value", *tiebreak)
    numbered = keyed.withColumn("_row", F.row_number().over(inside))
    joined = numbered.join(earlier, [*strata, "_bucket"])
    return joined.withColumn(column, (F.col("_before") + F.col("_row")).cast("long")).drop("_value", "_bucket", "_row", "_before")


def draw_by_quota(df: DataFrame, strata: Sequence[str], quotas: DataFrame, order_value: Column,
                  tiebreak: Sequence[str], quota: str = "quota", buckets: int = 1024) -> DataFrame:
    """The ``quota`` rows with the smallest order value of every stratum, exactly.

    Buckets past the quota are dropped before any shuffle of rows; at most one bucket per
    stratum is cut in the middle.
    """
    keyed = df.withColumn("_value", order_value).withColumn("_bucket", F.floor(F.col("_value") * buckets).cast("int"))
    offsets = _bucket_offsets(keyed, strata)
    needed = offsets.join(quotas.select(*strata, F.col(quota).alias("_quota")), list(strata)).where("_before < _quota")
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_value", *tiebreak)
    kept = keyed.join(needed, [*strata, "_bucket"]).withColumn("_row", F.row_number().over(inside))
    return kept.where(F.col("_before") + F.col("_row") <= F.col("_quota")).drop("_value", "_bucket", "_row", "_before", "_quota")


def _bucket_offsets(keyed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows in earlier buckets of the same stratum; one row per (stratum, bucket)."""
    sizes = keyed.groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*strata, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, column: str = "rank") -> DataFrame:
    """Top n per group. The constant n lets Spark prune inside each task before the shuffle."""
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(column) <= n)
