"""Exact McNemar tails against sums of binomial coefficients."""

from fractions import Fraction
from math import comb

import pytest

from seqlab.operators.resampling import with_mcnemar_p


def test_tails_equal_exact_sums(spark):
    pairs = [(a, b) for a in range(0, 14) for b in range(0, 14)] + [(400, 350), (350, 400), (1000, 3), (3, 1000), (2500, 2500), (1, 0), (0, 5)]
    rows = with_mcnemar_p(spark.createDataFrame(pairs, "a_only long, b_only long")).collect()
    for r in rows:
        n = r.a_only + r.b_only
        exact = 1.0 if n == 0 else float(Fraction(sum(comb(n, k) for k in range(r.a_only, n + 1)), 2**n))
        assert r.p_value == pytest.approx(exact, rel=1e-9, abs=1e-13), (r.a_only, r.b_only)
