"""All links between different texts, against brute force."""

import random

import numpy as np
import pytest

from seqlab.llm import jaccard_join
from seqlab.llm.jaccard_join import jaccard_components, jaccard_pairs, overlaps

DOCS = "doc_id bigint, text string"


def shingles(text, n):
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i:i + n]) for i in range(max(len(ws) - n + 1, 1))) if ws else frozenset()


def edited(base, places):
    ws = list(base)
    for p in places:
        ws[p] = f"e{p}"
    return " ".join(ws)


def check_links(spark, docs, n, percent):
    """n_links of every row and the pair table; returns the number of links."""
    sets = [shingles(t, n) for _, t in docs]
    first = {}
    for (i, _), s in sorted(zip(docs, sets), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        first.setdefault(s, i)
    kinds = [s for s in first if s]
    links, want = {s: 0 for s in first}, []
    for k, a in enumerate(kinds):
        for b in kinds[:k]:
            common = len(a & b)
            if 100 * common >= percent * len(a | b):
                links[a] += 1
                links[b] += 1
                want.append((frozenset([(first[a], len(a)), (first[b], len(b))]), common))
    frame = spark.createDataFrame(docs, DOCS)
    got = jaccard_components(frame, n, percent).collect()
    assert sorted(repr((r.doc_id, r.n_links)) for r in got) == sorted(repr((i, links[s])) for (i, _), s in zip(docs, sets))
    pairs = jaccard_pairs(frame, n, percent).collect()
    assert len(pairs) == len(want)
    assert {(frozenset([(r.doc_a, r.n_a), (r.doc_b, r.n_b)]), r.common) for r in pairs} == set(want)
    return len(want)


def test_three_texts_have_two_links_each(spark):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, edited(base, [p])) for i, p in enumerate((40, 100, 160))]
    assert [r.n_links for r in jaccard_components(spark.createDataFrame(docs, DOCS)).collect()] == [2, 2, 2]


@pytest.mark.parametrize("tile_grams", [jaccard_join.TILE_GRAMS, 2048])
def test_links_of_families(spark, monkeypatch, tile_grams):
    monkeypatch.setattr(jaccard_join, "TILE_GRAMS", tile_grams)
    rng = random.Random(tile_grams)
    docs = [(None, None), (900, ""), (901, "one"), (902, "one"), (903, "one two")]
    for family, length in enumerate((40, 200, 900)):
        base = [f"f{family}w{i}" for i in range(length)]
        docs += [(100 * family + i, edited(base, rng.sample(range(length), rng.randint(0, max(2, length // 50))))) for i in range(40)]
    docs += docs[-5:]
    assert check_links(spark, docs, 3, 90) > 100


def test_links_of_five_words(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, edited(base, rng.sample(range(100), rng.randint(0, 3)))) for i in range(30)]
    assert check_links(spark, docs, 5, 80) > 30


def test_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    one, two = ([np.unique(rng.integers(0, 90, size, dtype=np.uint64)) for size in rng.integers(1, 60, k)] for k in (9, 5))
    assert (overlaps(one, two) == [[len(np.intersect1d(a, b)) for b in two] for a in one]).all()
    assert (overlaps([np.array([1], dtype=np.uint64)], [np.array([2], dtype=np.uint64)]) == 0).all()
