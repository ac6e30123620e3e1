"""Draws and ranking replicates against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import resampling as RS

CUTS = RS.poisson_cuts()


def weight(key, replicate, seed=42):
    digest = hashlib.md5(f"{seed}|boot|{key}|{replicate // 8}".encode()).hexdigest()
    part = digest[4 * (replicate % 8):4 * (replicate % 8) + 4]
    return sum(part >= cut for cut in CUTS)


def test_digests_of_short_and_long_ids():
    for ids in ([], [b"a|", b"bb|", "é中|".encode(), b"x" * 53], [b"a|", b"y" * 60]):
        expected = b"".join(hashlib.md5(i + str(n).encode()).digest() for i in ids for n in range(12))
        assert RS._digests(ids, 12).tobytes() == expected


def test_ranking_replicates_with_ties_over_slices(spark):
    rng = np.random.default_rng(3)
    # few scores: ties meet across tasks and labels; one model with distinct scores; one with a single label
    rows = [(m, f"k{i}", int(y), float(s)) for i, (y, a, b) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 5, 300) / 4, rng.random(300)))
            for m, s, y in (("ties", a, y), ("fine", b, y), ("one", b, 1))]
    df = spark.createDataFrame(rows, "model string, key string, label int, prob double").repartition(7)
    got = {(r.model, r.replicate): r for r in RS.bootstrap_ranking(df, ["model"], "key", 11, 42).collect()}
    assert len(got) == 33
    for (model, replicate), r in got.items():
        mine = [(s, y, weight(k, replicate)) for m, k, y, s in rows if m == model]
        p, n = sum(w for _, y, w in mine if y), sum(w for _, y, w in mine if not y)
        wins = sum(w * v * ((s > t) + (s == t) / 2) for s, y, w in mine if y for t, z, v in mine if not z)
        ap = 0.0
        for score in {s for s, _, _ in mine}:
            hit, false = (sum(w for s, y, w in mine if s >= score and y == k) for k in (1, 0))
            here = sum(w for s, y, w in mine if s == score and y)
            ap += here * hit / (hit + false) if hit + false else 0.0
        assert r.roc_auc == pytest.approx(wins / p / n) if n else r.roc_auc is None
        assert r.pr_auc == pytest.approx(ap / p)


def test_a_score_travels_once_for_all_replicates(spark):
    df = spark.range(500).select(F.lit("a").alias("model"), F.col("id").cast("string").alias("key"), (F.col("id") % 2).alias("label"), (F.col("id") / 500).alias("prob"))
    rows = RS._grouped_draws(df, ["model", "prob", "label"], "key", 40, "42|boot", 8, RS._poisson, packed=True)
    assert rows.count() == 500 and rows.agg(F.max(F.length("w"))).first()[0] == 20


def test_ranking_intervals_draw_as_many_replicates_as_the_others(spark, monkeypatch):
    from seqlab.plans import metric_queries as Q
    from seqlab.plans.registry import ORACLES, QUERIES

    drawn, ranking = [], RS.bootstrap_ranking
    monkeypatch.setattr(RS, "bootstrap_ranking", lambda df, by, key, replicates, seed: drawn.append(replicates) or ranking(df, by, key, replicates, seed))
    rows = QUERIES["M08_bootstrap_auc"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 2 and drawn == [Q.N_BOOT] and Q.N_BOOT >= 200
    assert f"replicate < {Q.N_BOOT})" in ORACLES["M08_bootstrap_auc"]


def test_packed_rows_of_large_and_small_sums():
    import pyarrow as pa

    rows = [np.arange(7), np.arange(7) * 1000, np.zeros(7, dtype=np.int64), np.full(7, 16)]
    for some in (rows, rows[1:2], rows[:1], []):
        column = pa.array([RS._as_bytes(r) for r in some], pa.binary())
        assert (RS._unpacked(column, 7) == np.array(some).reshape(-1, 7)).all()
        assert (RS._unpacked(column[1:], 7) == np.array(some).reshape(-1, 7)[1:]).all()


def test_score_runs_of_equal_missing_and_nan_scores_over_batches():
    import pyarrow as pa

    rows = [("a", None, 1, 3), ("a", float("nan"), 1, 2), ("a", float("nan"), 0, 5), ("a", 0.5, 1, 20), ("a", 0.5, 0, 1), ("b", 0.5, 1, 4), ("b", 0.25, None, 9)]
    schema = pa.schema([("model", pa.string()), ("prob", pa.float64()), ("label", pa.int32()), ("w", pa.binary())])
    expected = [("a", 3, 0), ("a", 2, 5), ("a", 20, 1), ("b", 4, 0), ("b", 0, 0)]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(m, p, y, RS._as_bytes(np.array([w]))) for m, p, y, w in rows[i:i + size]]), schema.types)], schema=schema)
                   for i in range(0, 7, size)]
        runs = [(g[0], int(p), int(n)) for g, pos, neg in RS._score_runs(batches, ["model"], 1) for p, n in zip(pos[:, 0], neg[:, 0])]
        assert runs == expected
