"""Exact quantiles against numpy: ties, a hot value, null keys and values, empty groups, few and many slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators.quantiles import exact_quantiles, quantile_columns
from seqlab.operators.screening import quantile_table

POINTS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
SCHEMA = "g string, x double, y double"


def expected(rows):
    out = {}
    for g in {r[0] for r in rows}:
        for metric, place in (("x", 1), ("y", 2)):
            values = [r[place] for r in rows if r[0] == g and r[place] is not None]
            for i, p in enumerate(POINTS):
                if values:
                    out[g, metric, i] = float(np.quantile(values, p))
    return out


@pytest.mark.parametrize("slices", [1, 2, 7, 64])
def test_against_numpy(spark, slices):
    draw = np.random.default_rng(slices)
    rows = [("hot", 0.5, float(v)) for v in draw.normal(size=300)]  # one value owns most of x
    rows += [("hot", float(v), None) for v in draw.integers(0, 4, 80)]
    rows += [("one", 3.0, -1.0), (None, 2.0, 5.0), (None, 1.0, 5.0), ("empty", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.g, r.metric, r.i): r.value for r in exact_quantiles(df, ["g"], ["x", "y"], POINTS, slices).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_quantiles(df, ["g"], ["x", "y"], POINTS).count() == 0
    assert [r.value for r in quantile_table(df, ["x"], [0.5]).collect()] == [None]


def test_columns_of_different_points(spark):
    df = spark.range(11).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    got = quantile_columns(df, ["g"], {"median_x": ("x", 0.5), "p90_y": ("y", 0.9)}).first()
    assert (got.g, got.median_x, got.p90_y) == ("a", 5.0, 18.0)


def test_infinite_neighbours(spark):
    df = spark.createDataFrame([("a", float("inf"), None)] * 4, SCHEMA)
    assert exact_quantiles(df, ["g"], ["x"], [0.5]).first().value == float("inf")
