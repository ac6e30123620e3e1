"""Similarity joins against brute force."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from seqlab.operators import similarity as SIM


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s))
        kind = rng.choice("sid")
        if kind == "s":
            s[at] = rng.choice("ACDK")
        elif kind == "i":
            s.insert(at, rng.choice("ACDK"))
        elif len(s) > 10:
            del s[at]
    return "".join(s)[:50]


def fixture():
    rng = random.Random(3)
    seeds = ["".join(rng.choice("ACDK") for _ in range(rng.randrange(10, 46))) for _ in range(25)]
    out = set(seeds)
    for s in seeds[:12]:
        for n in (1, 2, 3, 4, 6, 9):
            out.add(mutate(rng, s, n))
    return sorted(out)


def test_clusters_match_brute_force(spark):
    seqs = fixture()
    parent = {s: s for s in seqs}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(seqs):
        for b in seqs[:i]:
            if distance(a, b) <= int(0.2 * min(len(a), len(b)) + 1e-9):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    expected = {s: find(s) for s in seqs}
    rows = SIM.similarity_clusters(spark.createDataFrame([(s,) for s in seqs + seqs[:5]], ["sequence"])).collect()
    got = {r.sequence: r.cluster_id for r in rows}
    assert got == expected
    assert 1 < len(set(got.values())) < len(seqs)


def test_novelty_matches_brute_force(spark):
    seqs = fixture()
    known, queries = seqs[::3], seqs[1::2]
    rows = SIM.novelty(
        spark.createDataFrame([(s,) for s in queries], ["sequence"]),
        spark.createDataFrame(list(enumerate(known)), "idx long, known string")).collect()
    assert len(rows) == len(set(queries))
    for r in rows:
        best, match = 0.0, ""
        for k in known:
            sim = SequenceMatcher(None, r.sequence, k).ratio()
            if sim > best:
                best, match = sim, k
                if best >= 0.95:
                    break
        assert r.is_novel == (best < 0.8)
        if not r.is_novel:
            assert (round(r.max_similarity, 9), r.best_match) == (round(best, 9), match)


def test_novelty_at_a_low_threshold_and_with_any_letters(spark, monkeypatch):
    monkeypatch.setattr(SIM, "KNOWN_BLOCK", 5)
    monkeypatch.setattr(SIM, "QUERY_BUCKET", 7)
    seqs = fixture() + ["BBJJOOUUXXZZ", "BBJJOOUUXXZB", "b\u00e9\u4e2d\u6587zzoo", "b\u00e9\u4e2d\u6587zzo", "ACD" * 40, "ACDK" * 30]
    known, queries = seqs[::3], seqs[1::2]
    rows = SIM.novelty(
        spark.createDataFrame([(s,) for s in queries], ["sequence"]),
        spark.createDataFrame(list(enumerate(known)), "idx long, known string"), 0.5).collect()
    assert len(rows) == len(set(queries))
    for r in rows:
        ratios = [SequenceMatcher(None, r.sequence, k).ratio() for k in known]
        first = next((i for i, x in enumerate(ratios) if x >= 0.95), ratios.index(max(ratios)))
        assert r.is_novel == (max(ratios) < 0.5)
        if not r.is_novel:
            assert (r.max_similarity, r.best_match) == (ratios[first], known[first])


def test_novelty_scores_few_pairs(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randrange(10, 51))) for _ in range(600)]
    pairs = sum(len(left) for left, _ in SIM.possible_matches(texts[:400], texts[400:], 0.8))
    assert pairs < 400 * 200 // 1000


def test_identical_string_is_not_novel(spark):
    suspects = ["RRAAVVNIVIRR", "MARRLLVWKWAGHAA", "KWKLFKKIGIGKFLHSAK"]
    rows = SIM.novelty(
        spark.createDataFrame([(s,) for s in suspects], ["sequence"]),
        spark.createDataFrame([(0, "KWKLFKKIGIGKFLHSAK")], "idx long, known string"))
    got = {r.sequence: r for r in rows.collect()}
    assert not got["KWKLFKKIGIGKFLHSAK"].is_novel and got["KWKLFKKIGIGKFLHSAK"].max_similarity == 1.0
    assert got["MARRLLVWKWAGHAA"].is_novel


def test_a_tile_links_what_brute_force_links():
    rng = random.Random(1)
    for letters, low, high in (("ACDK", 2, 46), ("ABé中\U0001f600", 2, 30), ("ACD", 55, 80)):
        seeds = ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(20)]
        seqs = sorted({*seeds, *(mutate(rng, s, n) for s in seeds for n in (1, 2, 4))}, key=lambda s: (len(s), s))
        half = len(seqs) // 2
        for identity in (0.6, 0.8):
            near = [(i, j) for j in range(len(seqs)) for i in range(j) if distance(seqs[i], seqs[j]) <= int(len(seqs[i]) * round(1 - identity, 9) + 1e-9)]
            cases = [(near, SIM.linked_members(seqs, None, identity)), ([(i, j) for i, j in near if i < half <= j], SIM.linked_members(seqs[:half], seqs[half:], identity))]
            for links, (member, first) in cases:
                roots = [list(range(len(seqs))) for _ in range(2)]
                for root, pairs in zip(roots, (links, list(zip(member.tolist(), first.tolist())))):
                    for a, b in pairs:
                        x, y = sorted((root[a], root[b]))
                        root[:] = [x if r == y else r for r in root]
                assert roots[0] == roots[1]


def test_clusters_send_blocks_and_few_links(spark, monkeypatch):
    monkeypatch.setattr(SIM, "BLOCK_LEAST", 60)
    monkeypatch.setattr(SIM, "BLOCK_MOST", 60)
    rng = random.Random(4)
    words = ["THERE", "WHICH", "STAND", "HEARD", "LINES", "MAKES", "WATER", "GREAT"]
    family = {mutate(rng, "THEREWHICHSTANDHEARD", 1) for _ in range(400)}
    others = {"".join(rng.choice(words) for _ in range(rng.randrange(3, 9))) for _ in range(300)}
    seqs = sorted(family | others)
    frame = spark.createDataFrame(list(enumerate(seqs)), "sid long, sequence string")
    blocks = SIM.sequence_blocks(frame)
    packed = blocks.selectExpr("sum(length(members)) AS bytes", "count(*) AS n").first()
    assert packed.n >= len(seqs) / 60 and packed.bytes < 40 * len(seqs) + 600 * packed.n
    links = SIM.block_links(blocks, 0.8).collect()
    assert len(links) < packed.n * len(seqs)  # a tile sends at most one link for each member
    parent = {s: s for s in seqs}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(seqs):
        for b in seqs[:i]:
            t = int(0.2 * min(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) <= t and find(a) != find(b) and distance(a, b) <= t:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.sequence: r.cluster_id for r in SIM.similarity_clusters(frame.select("sequence")).collect()}
    assert got == {s: find(s) for s in seqs}


def test_an_index_loses_no_pair_of_a_tile(monkeypatch):
    monkeypatch.setattr(SIM, "_LOOK_COST", 0)
    monkeypatch.setattr(SIM, "_CANDIDATE_COST", 0)  # the index is taken however few the rows
    test_a_tile_links_what_brute_force_links()


def test_index_meets_few_pairs_and_all_near_ones():
    rng = random.Random(9)
    one = sorted({"".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30)) for _ in range(1500)})
    two = sorted({(mutate(rng, s, 3) + "ACDEFG")[:33] for s in one[:300]} | {"".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(33)) for _ in range(1200)})
    tile = SIM._Tile(one + two)
    index = SIM._Segments(tile, 0, len(one), 6)
    found = index.candidates(tile.matrix(len(one), len(one) + len(two)))
    assert sum(int(many.sum()) for *_, many in found) < len(one) * len(two) // 50
    left = {(int(a), int(b)) for x, y in index.near(found, tile.letters[len(one):], tile.running(len(one), len(one) + len(two))) for a, b in zip(x, y)}
    near = {(i, j) for i in range(0, 300, 20) for j in range(len(two)) if distance(one[i], two[j]) <= 6}
    assert near and near <= left and len(left) < len(one) * len(two) // 1000


def test_distances_of_a_word_match_brute_force():
    import numpy as np

    rng = random.Random(10)
    texts = ["".join(rng.choice("ACD") for _ in range(n)) for n in (0, 1, 2, 5, 33, 63, 64) for _ in range(4)]
    texts += [mutate(rng, s + "AC", 3) for s in texts if len(s) > 10]
    tile = SIM._Tile(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if len(texts[i]) <= len(texts[j])]
    a, b = (np.array(x) for x in zip(*pairs))
    exact = np.array([distance(texts[i], texts[j]) for i, j in pairs])
    for limit in (0, 1, 5, 20, 40):
        assert (tile.within(a, b, np.full(len(a), limit)) == (exact <= limit)).all()


def test_tasks_of_several_tiles_find_the_same_clusters(spark, monkeypatch):
    seqs = fixture()
    frame = spark.createDataFrame([(s,) for s in seqs], ["sequence"])
    monkeypatch.setattr(SIM, "BLOCK_LEAST", 9)
    monkeypatch.setattr(SIM, "BLOCK_MOST", 9)
    found = []
    for tasks in (1000, 0.2):
        monkeypatch.setattr(SIM, "_TASKS", tasks)
        found.append(sorted(map(tuple, SIM.similarity_clusters(frame).collect())))
    assert found[0] == found[1] and len({c for _, c in found[0]}) < len(seqs)
    blocks = SIM.sequence_blocks(spark.createDataFrame(list(enumerate(seqs)), "sid long, sequence string"))
    assert blocks.count() > 8 and len(set(map(tuple, SIM.block_links(blocks, 0.8).collect()))) > 0
