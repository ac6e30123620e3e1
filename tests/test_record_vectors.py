"""Batch descriptors against plain Python, with empty, null and very long records and other letters."""

import math
import random
from collections import Counter

from seqlab.functions import descriptors as D
from seqlab.functions.scalars import RESIDUES
from seqlab.operators import record_vectors as RV

rng = random.Random(11)
SEQS = ["", "A", "KR", "ACDKKKRW"] + ["".join(rng.choice(RESIDUES) for _ in range(n)) for n in (17, 300, 400_000)]
ROWS = [(i, ("x", "y", None)[i % 3], s) for i, s in enumerate(SEQS)]
FRAME = "id long, g string, s string"


def test_quasi_order_of_long_and_short_records(spark):
    distance = {a + b: abs(D.KD[a] - D.KD[b]) for a in RESIDUES for b in RESIDUES}
    rows = [*ROWS, (98, "x", None), (99, "x", "AXA")]
    got = {r.id: r for r in RV.with_quasi_order(spark.createDataFrame(rows, FRAME), "s", distance, 2).collect()}
    assert got[98].SOCN_1 is None and got[99].QSO_A is None
    for i, _, s in ROWS:
        tau = [sum(distance[a + b] ** 2 for a, b in zip(s, s[k:])) for k in (1, 2)]
        bottom = 1 + 0.1 * sum(tau)
        assert math.isclose(got[i].SOCN_2, tau[1], abs_tol=1e-6, rel_tol=1e-9)
        assert math.isclose(got[i].QSO_lag1, 0.1 * tau[0] / bottom, abs_tol=1e-9)
        assert math.isclose(got[i].QSO_K, s.count("K") / max(len(s), 1) / bottom, abs_tol=1e-9)


def test_class_changes_and_physical_vector(spark):
    df = spark.createDataFrame(ROWS, FRAME)
    got = {r.id: r for r in RV.with_phys8(RV.with_ctdt(df, "s"), "s").collect()}
    old = {r.id: r for r in D.with_phys8(df.where("length(s) < 1000").select("*", *D.ctdt(df["s"])), "s").collect()}
    assert got[0].CTDT_charge_12 == 0.0 and got[0].phys8_pi_norm == 0.0
    for i, row in old.items():
        assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(row[3:18], [got[i][n] for n in row.__fields__[3:18]]))
        assert all(math.isclose(row[f"phys8_{n}"], got[i][f"phys8_{n}"], abs_tol=1e-9) for n in D.PHYS8)


def test_profile_of_tuples_with_any_letters_and_null_groups(spark):
    rows = [(i, g, s) for i, g, s in ROWS if len(s) < 1000] + [(50, "x", "zézé"), (51, "x", None)]
    kinds = [(1, 0, ""), (2, 1, ".d2"), (3, 0, ".t")]
    got = {(r.g, r.feature): (r.n_occurrences, r.mean_frequency) for r in RV.tuple_profile(spark.createDataFrame(rows, FRAME), ["g"], "s", kinds, {"b": "KR"}).collect()}
    n, total = Counter(), Counter()
    records = Counter(g for _, g, _ in rows)
    for _, g, s in rows:
        s = (s or "").replace("K", "b").replace("R", "b")
        for items, ending in ((list(s), ""), ([s[i] + s[i + 2] for i in range(len(s) - 2)], ".d2"), ([s[i:i + 3] for i in range(len(s) - 2)], ".t")):
            for x in items:
                n[g, x + ending] += 1
                total[g, x + ending] += 1 / len(items)
    assert {k: v for k, (v, _) in got.items()} == dict(n)
    assert all(math.isclose(got[k][1], total[k] / records[k[0]], rel_tol=1e-9) for k in n)
