"""Linear pair and triad profiles against counting in Python."""

import random
from collections import Counter, defaultdict

import pytest

from seqlab.functions.descriptors import SEVEN_CLASSES
from seqlab.operators.ordered_counts import class_triad_profile, skip_pair_profile


def rows():
    rng = random.Random(2)
    out = [("a", ""), ("a", None), ("b", "C"), (None, "ACAC"), ("b", "ACD" * 4000)]
    return out + [(rng.choice("abc"), "".join(rng.choice("ACDKX") for _ in range(rng.randrange(0, 70)))) for _ in range(200)]


def test_pairs_at_all_distances(spark):
    n, total, size = Counter(), defaultdict(float), Counter()
    for g, s in rows():
        size[g] += 1
        s = (s or "").replace("X", "")
        seen, found = Counter(), Counter()
        for y in s:
            for x, k in seen.items():
                found[x + y] += k
            seen[y] += 1
        for item, k in found.items():
            n[g, item] += k
            total[g, item] += k / (len(s) * (len(s) - 1) / 2)
    got = {(r.g, r.feature): (r.n_occurrences, r.mean_frequency) for r in skip_pair_profile(spark.createDataFrame(rows(), "g string, s string"), "g", "s").collect()}
    assert got == {k: (v, pytest.approx(total[k] / size[k[0]])) for k, v in n.items()}


def test_triads(spark):
    code = {letter: sign for sign, letters in SEVEN_CLASSES.items() for letter in letters}
    total, size = defaultdict(float), Counter()
    for g, s in rows():
        size[g] += 1
        z = "".join(code.get(x, "") for x in s or "")
        for gap in (0, 2):
            found = Counter(z[i] + z[i + gap + 1] + z[i + 2 * gap + 2] for i in range(len(z) - 2 * gap - 2))
            for t, k in found.items():
                total[g, f"{t}.gap{gap}"] += k / max(found.values())
    got = {(r.g, r.feature): r.mean_share for r in class_triad_profile(spark.createDataFrame(rows(), "g string, s string"), "g", "s", (0, 2), SEVEN_CLASSES).collect()}
    assert got == {k: pytest.approx(v / size[k[0]]) for k, v in total.items()}


def test_empty(spark):
    empty = spark.createDataFrame([], "g string, s string")
    assert skip_pair_profile(empty, "g", "s").count() == 0
    assert class_triad_profile(empty, "g", "s", (0,), SEVEN_CLASSES).count() == 0
