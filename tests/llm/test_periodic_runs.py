"""Runs and collapsed texts against brute force, and the defined small cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from seqlab.llm.periodic_runs import CoverLce, find_runs, periodic_runs, planted_periods, run_digests


def brute_runs(w, min_length=6, exponent=4):
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            if length >= max(min_length, exponent * q):
                out.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def result(docs):
    rows = run_digests(periodic_runs(docs, rewrite=planted_periods))
    return sorted(map(tuple, rows.collect()), key=repr)


def test_extensions_equal_word_by_word():
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 50, 333):
        x = np.concatenate([rng.integers(0, 2, n), [-5]])
        lce = CoverLce(x)
        i, j = np.array([(i, j) for i in range(len(x)) for j in range(len(x)) if i != j]).T
        naive = []
        for a, b in zip(i, j):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            naive.append(k)
        assert lce(i, j).tolist() == naive


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(300):
        w = [rng.randrange(letters) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.5:
            unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
            w += unit * rng.randrange(3, 8) + unit[:rng.randrange(len(unit))]
        texts.append(w)
    words = np.array([x for w in texts for x in w], dtype=np.int64)
    found = find_runs(words, np.array([len(w) for w in texts]), 6, 4)
    expected = [(i, *r) for i, w in enumerate(texts) for r in brute_runs(w)]
    assert [tuple(r) for r in found.tolist()] == expected


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = sorted((brute_row(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert result(docs) == expected
    assert sum(r[1] > 0 for r in expected) > 5


def test_small_cases(spark):
    long = "a b " * 5000 + "x " + "c d e f " * 2000 + "ü ß z " * 9
    rows = [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b b b b b b b q"), (None, None),
            (5, long), (6, "a a a a a"), (7, "w x y z " * 4), (8, "w x y z " * 4 + "w"), (0, "  x y " * 12), (-3, "A a A a A a A a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as runs", "2 as n_words", "3 as collapsed")
    assert result(docs) == sorted((brute_row(*r) for r in rows), key=repr)
    assert result(docs.limit(0)) == []


def test_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "say ha ha ha ha ha ha now")], "doc_id long, text string")
    row = periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1)] and row.collapsed == "say ha now" and row.n_words == 8
