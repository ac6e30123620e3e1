"""The significance tables against plain loops over rows, replicates and models."""

import hashlib
import math

import numpy as np
import pytest

from seqlab.operators.metrics import THRESHOLD_METRICS
from seqlab.operators.resampling import poisson_cuts
from seqlab.operators.significance import Comparison

REPLICATES, SEED = 40, 7


def metric(y, hit, w):
    tp, fp = w[(y == 1) & hit].sum(), w[(y == 0) & hit].sum()
    tn, fn = w[(y == 0) & ~hit].sum(), w[(y == 1) & ~hit].sum()
    ratio = lambda a, b: a / b if b else 0.0
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    root = math.sqrt(float(tp + fp)) * math.sqrt(float(tp + fn)) * math.sqrt(float(tn + fp)) * math.sqrt(float(tn + fn))
    values = (sens, spec, ratio(tp, tp + fp), ratio(tn, tn + fn), ratio(tp + tn, w.sum()), (sens + spec) / 2,
              ratio(2 * tp, 2 * tp + fp + fn), ratio(float(tp) * tn - float(fp) * fn, root))
    return dict(zip(THRESHOLD_METRICS, values))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(3)
    y = draw.integers(0, 2, 150)
    noisy = lambda s: np.clip(y * 0.4 + 0.3 + draw.normal(0, s, len(y)), 0, 1)
    return y, {"t": noisy(0.15), "u": noisy(0.3), "v": noisy(0.6)}


def test_tables(spark, rows):
    y, probs = rows
    table = [("g", str(i), int(y[i]), *(float(p[i]) for p in probs.values())) for i in range(len(y))]
    df = spark.createDataFrame(table, "grp string, id string, label int, t double, u double, v double").repartition(5)
    job = Comparison(df, ["grp"], "id", {m: m for m in probs}, 0.5, REPLICATES, SEED)
    hits = {m: p >= 0.5 for m, p in probs.items()}
    digest = lambda kind, i, block: hashlib.md5(f"{SEED}|{kind}|{i}|{block}".encode()).hexdigest()
    ones = np.ones(len(y), dtype=int)

    seen = {m: metric(y, h, ones) for m, h in hits.items()}
    cuts = poisson_cuts()
    boots = {m: [] for m in probs}
    for r in range(REPLICATES):
        w = np.array([sum(digest("boot", i, r // 8)[4 * (r % 8):4 * (r % 8) + 4] >= cut for cut in cuts) for i in range(len(y))])
        for m in probs:
            boots[m].append(metric(y, hits[m], w))
    for row in job.intervals().collect():
        drawn = [b[row.metric] for b in boots[row.model]]
        assert row.value == pytest.approx(seen[row.model][row.metric])
        assert (row.low, row.high) == pytest.approx(tuple(np.quantile(drawn, [0.025, 0.975])))

    got = {(r.comparator, r.metric): r for r in job.comparisons().collect()}
    assert len(got) == 2 * len(THRESHOLD_METRICS)
    for other in ("u", "v"):
        swapped = []
        for r in range(REPLICATES):
            s = np.array([digest("swap", i, r // 32)[r % 32] >= "8" for i in range(len(y))])
            a, b = np.where(s, hits[other], hits["t"]), np.where(s, hits["t"], hits[other])
            first, second = metric(y, a, ones), metric(y, b, ones)
            swapped.append({k: first[k] - second[k] for k in first})
        for k in THRESHOLD_METRICS:
            row, delta = got[other, k], seen["t"][k] - seen[other][k]
            drawn = [x[k] - z[k] for x, z in zip(boots["t"], boots[other])]
            assert row.delta == pytest.approx(delta)
            assert (row.low, row.high) == pytest.approx(tuple(np.quantile(drawn, [0.025, 0.975])))
            p = lambda n: 1.0 if delta <= 0 else (n + 1) / (REPLICATES + 1)
            assert row.bootstrap_p == pytest.approx(p(sum(d <= 0 for d in drawn)))
            assert row.permutation_p == pytest.approx(p(sum(d[k] >= delta - 1e-12 for d in swapped)))

    for row in job.mcnemar().collect():
        right, other = hits["t"] == (y == 1), hits[row.comparator] == (y == 1)
        a, b = int((right & ~other).sum()), int((other & ~right).sum())
        assert (row.a_only, row.b_only) == (a, b)
        assert row.p_value == pytest.approx(sum(math.comb(a + b, i) for i in range(a, a + b + 1)) / 2 ** (a + b))

    best = {r.metric: r.comparator for r in job.best_comparisons().collect()}
    assert best == {k: max("uv", key=lambda m: seen[m][k]) for k in THRESHOLD_METRICS}


def test_no_rows_and_one_model(spark):
    df = spark.createDataFrame([], "grp string, id string, label int, t double, u double")
    job = Comparison(df, ["grp"], "id", {"t": "t", "u": "u"}, 0.5, 4)
    assert job.comparisons().count() == job.intervals().count() == job.mcnemar().count() == 0
    with pytest.raises(ValueError):
        Comparison(df, ["grp"], "id", {"t": "t"})
