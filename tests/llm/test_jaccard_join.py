import random
import re

import numpy as np
import pytest

from seqlab.llm.jaccard_join import band_limits, band_of, jaccard_components, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def shingles(text):
    ws = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(ws[i:i + 3]) for i in range(max(len(ws) - 2, 1))} if ws else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    where, parent = {}, list(range(len(docs)))
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        met = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    met[j] = met.get(j, 0) + 1
        for j, common in met.items():
            if 100 * common >= 90 * (len(s) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [docs[i][0] for i in g if docs[i][0] is not None]
        out += [(docs[i][0], len(sets[i]), min(ids) if ids else None) for i in g]
    return sorted(map(repr, out))


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id bigint, text string, key int, sum1 string")
    got = jaccard_components(df).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(docs)
    firsts = [r.component_id for r in got if r.first_of_component and r.n_shingles]
    assert len(firsts) == len(set(firsts))


def family(rng, base, n, edits, start):
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
        out.append((start + i, " ".join(ws)))
    return out


def test_bands():
    assert all(band_limits(band_of(s))[0] <= s <= band_limits(band_of(s))[1] for s in range(1, 5000))


def test_small_cases(spark):
    check(spark, [(5, "a b c d"), (3, "A b  c\td"), (3, "a b c d"), (None, "a b c d"), (9, None), (8, ""), (7, " \n"), (6, "one"), (2, "one"), (1, "one two"), (4, "two one"), (10, "é à é à é à é")])


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("length, edits", [(12, 1), (40, 2), (200, 6), (700, 14)])
def test_families(spark, length, edits):
    rng = random.Random(length)
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    docs = family(rng, base, 120, edits, 1000) + family(rng, base[: length - length // 20], 20, edits, 0)
    docs += [(5000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(length // 2)) + " " + " ".join(base[: length // 2])) for i in range(60)]
    check(spark, docs)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs)


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        common, one, two = (rng.integers(0, 1 << 63, int(rng.integers(1, n)), dtype=np.uint64) for n in (400, 60, 60))
        a, b = (np.unique(np.concatenate([common, own])) for own in (one, two))
        x, y = sorted((sketch(a), sketch(b)), key=len)
        while len(y) > len(x):
            y = y[:len(y) // 2] ^ y[len(y) // 2:]
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
