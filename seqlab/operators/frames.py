"""Trajectory frame tables: slices, state fractions, windows and the residue-by-time pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def frame_slice(df: DataFrame, frame: str, start: int, stop: int | None, stride: int) -> DataFrame:
    keep = (F.col(frame) >= start) & ((F.col(frame) - start) % stride == 0)
    return df.where(keep if stop is None else keep & (F.col(frame) < stop))


def state_fractions(df: DataFrame, frame: Sequence[str], state: Column) -> DataFrame:
    return df.groupBy(*frame).agg(F.avg(state.cast("int")).alias("fraction"))


def fraction_summary(fractions: DataFrame, time: str, low: float, high: float) -> DataFrame:
    """First frame, last frame and the mean inside a closed time window."""
    inside = F.col(time).between(low, high)
    return fractions.agg(
        F.min_by("fraction", time).alias("initial"), F.max_by("fraction", time).alias("final"),
        F.avg(F.when(inside, F.col("fraction"))).alias("window_mean"))


def state_matrix(df: DataFrame, time: str, residue: str, code: Column, residues: Sequence, order: Column) -> DataFrame:
    """Time by residue table of coded states; the residue list is given, so no extra job finds it.

    Of several states in one cell that with the largest ``order`` counts; a cell without a state is null.
    """
    return df.groupBy(time).pivot(residue, list(residues)).agg(F.max_by(code, order))
