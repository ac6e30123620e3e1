"""How many pairs of a large family of near copies are counted before its components stand."""

import random

import numpy as np

from seqlab.llm import jaccard_join
from seqlab.llm.jaccard_join import SKETCH_BITS, jaccard_components, sketch

from test_jaccard_links import DOCS, edited, shingles


def test_a_family_is_linked_with_few_comparisons(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    docs = [(i, edited(base, rng.sample(range(100), rng.randint(1, 4)))) for i in range(300)]
    counted, plain = [], jaccard_join.linked

    def linked(documents, members, pairs, n, percent):
        pairs = jaccard_join.staged(pairs)
        counted.append(pairs.count())
        return plain(documents, members, pairs, n, percent)

    monkeypatch.setattr(jaccard_join, "linked", linked)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_components(spark.createDataFrame(docs, DOCS), 5, 80).collect()}
    sets = [shingles(t, 5) for _, t in docs]
    near = [[j for j in range(300) if sets[j] != s and 5 * len(s & sets[j]) >= 4 * len(s | sets[j])] for s in sets]
    least = {}
    for i in range(300):
        open_, seen = [i], {i}
        while i not in least and open_:
            k = open_.pop()
            new = {*near[k], *(j for j in range(300) if sets[j] == sets[k])} - seen
            seen |= new
            open_ += new
        least.update(dict.fromkeys(seen, min(seen)) if i not in least else {})
    assert {i: c for i, (c, _) in got.items()} == least
    assert all(got[i][1] == len({frozenset(sets[j]) for j in near[i]}) for i in range(300))
    print("pairs counted", counted, "links", sum(map(len, near)) // 2, "components", len(set(least.values())))
    assert sum(counted) < 3 * len(docs)


def test_folded_sketches_never_differ_more_than_the_sets(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(60):
        common, one, two = (rng.integers(0, 1 << 63, int(rng.integers(1, n)), dtype=np.uint64) for n in (200, 20, 20))
        pairs.append([np.unique(np.concatenate([common, own])) for own in (one, two)])
    rows = [(len(np.setxor1d(a, b)), len(a), sketch(a).tolist(), len(b), sketch(b).tolist()) for a, b in pairs]
    frame = spark.createDataFrame(rows, "apart int, na int, sketcha array<bigint>, nb int, sketchb array<bigint>")
    fine = frame.select("apart", jaccard_join._apart("a", "b", 60).alias("bits"), "na", "nb", *(jaccard_join._folded(f"sketch{x}").alias(f"sketch{x}") for x in "ab"))
    found = fine.select("apart", "bits", jaccard_join._apart("a", "b", 60).alias("coarse")).where("bits is not null").collect()
    assert len(found) > 30 and all(r.coarse <= r.bits <= r.apart for r in found)
    assert all(64 * len(sketch(a)) >= SKETCH_BITS * len(a) for pair in pairs for a in pair)
