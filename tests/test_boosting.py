"""Boosted trees: the first cut against all cuts, held-out accuracy, stored models scored again, small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlab.operators import boosting as BO
from seqlab.operators import models as ML
from seqlab.plans import model_queries as Q
from seqlab.plans.registry import Tables

FEW = BO.Boosting(trees=20)


def test_first_cut_is_the_best_of_all():
    rng = np.random.default_rng(1)
    x, s = rng.normal(size=(200, 4)).round(1), BO.Boosting(trees=1, leaves=2, rows=1.0, bins=256, least=5)
    y = (x[:, 2] + 0.3 * rng.normal(size=200) > 0.2).astype(float)
    root = BO.fit_trees(x, y, 3, s)[1]
    g, h = y.mean() - y, y.mean() * (1 - y.mean())
    best = max((sum(g[m].sum() ** 2 / (h * m.sum() + 1) for m in (x[:, f] <= v, x[:, f] > v)), f, v)
               for f in range(4) for v in np.unique(x[:, f]) if 5 <= (x[:, f] <= v).sum() <= 195)
    assert root[2] == best[1] and root[3] == best[2]


def test_trees_stay_within_leaves_and_depth():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    nodes = BO.fit_trees(x, y, 1, BO.Boosting(trees=5, leaves=9, depth=4))
    for tree in range(5):
        mine = {n[1]: n for n in nodes if n[0] == tree}
        assert sum(n[2] < 0 for n in mine.values()) <= 9
        depth = {0: 0}
        for n in sorted(mine):
            if mine[n][2] >= 0:
                depth[mine[n][4]] = depth[mine[n][5]] = depth[n] + 1
        assert max(depth.values()) <= 4


def test_held_out_rows_and_stored_models(spark):
    # the table's classes cannot be told from its vectors; a label that can be
    data = Q._emb(Tables(spark, "/root/testdata/sf0.01")).withColumn("label", F.expr("int(features[3] + 0.5 * features[7] > 0)"))
    path = BO.store(BO.fit_ensembles(data.where("split = 'train'"), {"all": range(64), "half": range(32)}, (7, 13)))
    fresh = BO.load(spark.newSession(), path)
    rows = {(r.name, r.seed): r.roc_auc for r in ML.evaluate(BO.score(data.where("split = 'test'"), BO.load(spark, path), ["label"]), ["name", "seed"]).collect()}
    assert set(rows) == {("all", 7), ("all", 13), ("half", 7), ("half", 13)}
    assert min(rows.values()) > 0.85
    other = spark.newSession().read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("embedding", "features")
    again = sorted(map(tuple, BO.score(other, fresh, ["vec_id"]).collect()))
    assert again == sorted(map(tuple, BO.score(data, BO.load(spark, path), ["vec_id"]).collect()))
    share = BO.gains(BO.load(spark, path), Q.EMB).groupBy("name", "seed").agg({"gain": "sum"}).collect()
    assert [r[2] for r in share] == [pytest.approx(1.0)] * 4


def test_order_of_rows_does_not_matter(spark):
    data = Q._emb(Tables(spark, "/root/testdata/sf0.001"))
    nodes = lambda df: sorted(map(tuple, BO.fit_ensembles(df, {"a": [1, 5, 9]}, (7,), FEW).collect()))
    assert nodes(data) == nodes(data.repartition(7))


def test_small_cases(spark):
    schema = "features array<double>, label int"
    one = spark.createDataFrame([([1.0, None], 1)] * 3 + [(None, 0), ([2.0, 3.0], None)], schema)
    models = BO.fit_ensembles(one, {"a": [0, 1]}, (1,), FEW)
    assert models.where("tree >= 0 and feature >= 0").count() == 0  # one class, three rows: nothing to cut
    assert BO.score(one, models, ["label"]).count() == 4
    empty = one.limit(0)
    assert BO.fit_ensembles(empty, {"a": [0]}, (1,), FEW).count() == 0
    assert BO.score(empty, models, ["label"]).count() == 0


def test_a_fit_holds_bins_not_copies_of_the_features():
    import tracemalloc

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60_000, 32))
    y = (x[:, 0] > 0).astype(float)
    tracemalloc.start()
    BO.fit_trees(x, y, 1, BO.Boosting(trees=2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes


def test_rows_are_arranged_by_label_then_features():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 3, size=(500, 4)).astype(float), rng.integers(0, 2, size=500).astype(float)
    columns = BO._Columns(pa.chunked_array([pa.array(list(x[:200])), pa.array(list(x[200:]))]), range(4))
    order = columns.arrange(y)
    expected = np.lexsort((*x.T, y))
    assert (x[order] == x[expected]).all() and (y[order] == y[expected]).all()
    assert (columns[2] == x[expected][:, 2]).all()


def test_pairs_of_features_count_like_single_ones():
    rng = np.random.default_rng(7)
    for d in (5, 6):
        binned, sums = rng.integers(0, 64, size=(d, 9000)).astype(np.uint8), np.vstack([rng.normal(size=(2, 9000)), np.ones(9000)])
        rows = np.flatnonzero(rng.random(9000) < 0.7)
        found = BO._sums(binned, BO._paired(binned, 64), rows, sums, 64)
        for f in range(d):
            for k in range(3):
                assert np.allclose(found[k, f], np.bincount(binned[f, rows], weights=sums[k, rows], minlength=64))


def test_every_labelled_row_takes_part(spark):
    n = 210_000  # more than a fit took before
    rows = spark.range(n).select(F.array(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double"), F.col("id").cast("double")).alias("features"), (F.col("id") >= n - 70_001).cast("int").alias("label"))
    few = BO.Boosting(trees=2, leaves=4)
    found = sorted(map(tuple, BO.fit_ensembles(rows, {"a": [0, 1], "b": [1]}, (7,), few).collect()))
    share = 70_001 / n
    assert [r[8] for r in found if r[2] == -1] == [pytest.approx(np.log(share / (1 - share)), rel=1e-12)] * 2
    ids = np.arange(n)
    x = np.stack([[r[0][0] for r in rows.select("features").collect()], ids], axis=1)
    cuts = {0: np.quantile(x[:, 0], np.linspace(0, 1, 65)[1:-1], method="lower"), 1: np.quantile(ids, np.linspace(0, 1, 65)[1:-1], method="lower")}
    assert all(r[5] in cuts[r[4]] for r in found if r[4] >= 0)
    root = next(r for r in found if r[:4] == ("b", 7, 0, 0))
    assert root[5] == max(c for c in cuts[1] if c < n - 70_001) or root[5] == min(c for c in cuts[1] if c >= n - 70_001)


def test_bins_in_a_file_give_the_same_nodes(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 7))
    y = (x[:, 1] + rng.normal(size=9000) > 0).astype(float)
    whole = BO.fit_trees(x, y, 3, FEW)
    monkeypatch.setattr(BO, "BLOCK_ROWS", 2500)
    monkeypatch.setattr(BO, "HELD_BYTES", 30_000)
    parts = BO.fit_trees(x, y, 3, FEW)
    assert [n[:3] + n[4:6] for n in parts] == [n[:3] + n[4:6] for n in whole]
    assert np.allclose([n[3:] for n in parts], [n[3:] for n in whole])


def test_models_that_share_a_task_are_fitted_one_by_one(spark, monkeypatch):
    data = Q._emb(Tables(spark, "/root/testdata/sf0.001"))
    alone = [sorted(map(tuple, BO.fit_ensembles(data, {name: columns}, (seed,), FEW).collect())) for name, columns in (("a", [1, 5, 9]), ("b", [9, 2])) for seed in (1, 2)]
    kind, dealt = type(data), type(data).repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, n, by: self.repartition(1) if n == 4 else dealt(self, n, by))
    together = BO.fit_ensembles(data, {"a": [1, 5, 9], "b": [9, 2]}, (1, 2), FEW).collect()
    assert sorted(map(tuple, together)) == sorted(sum(alone, []))
