import math
import re
import zlib
from collections import Counter

import pytest

from seqlab.llm.katz import discounts, score_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute(docs, check_sums=False):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in docs]
    texts = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for _, t in docs]
    uni, bi = Counter(), Counter()
    for ws, h in zip(texts, held):
        if not h:
            uni.update(ws)
            bi.update(zip(["<s>", *[w for w in ws[:-1]]], ws))
    total, types = sum(uni.values()), len(uni)
    one = discounts([sum(c == r for c in uni.values()) for r in range(1, 7)])
    two = discounts([sum(c == r for c in bi.values()) for r in range(1, 7)])
    d = lambda table, r: table[r - 1] if r <= 5 else 1.0
    p = {w: d(one, r) * r / (total + 1) for w, r in uni.items()}
    unknown = 1 - sum(p.values())
    context, after = Counter(), {}
    for (h, w), r in bi.items():
        context[h] += r
        after.setdefault(h, {})[w] = r
    alpha = {h: (1 - sum(d(two, r) * r / (context[h] + 1) for r in ws.values())) / (1 - sum(p[w] for w in ws)) for h, ws in after.items()}
    if check_sums:
        for h, ws in after.items():
            mass = sum(d(two, r) * r / (context[h] + 1) for r in ws.values()) + alpha[h] * (unknown + sum(q for w, q in p.items() if w not in ws))
            assert math.isclose(mass, 1, rel_tol=1e-9)
    out = []
    for (i, _), ws, hold in zip(docs, texts, held):
        base = sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (types + 1))) for w in ws)
        score = 0.0
        for h, w in zip(["<s>", *ws[:-1]], ws):
            r = bi[h, w]
            score += math.log10(d(two, r) * r / (context[h] + 1)) if r else math.log10(alpha.get(h, 1.0) * p.get(w, unknown))
        out.append((i, hold, len(ws), sum(uni[w] > 0 for w in ws), total, base, score))
    return out


def check(spark, docs, sums=False):
    df = spark.createDataFrame([(i, t, 1.0, 5) for i, t in docs], "doc_id bigint, text string, score double, n bigint")
    got = sorted(map(tuple, score_documents(df).collect()), key=repr)
    want = sorted(brute(docs, sums), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-6, abs=1e-5) and a[6] == pytest.approx(b[6], rel=1e-6, abs=1e-5)


@pytest.mark.parametrize("docs", [
    [(1, "a b a b c"), (2, "A b\tc d"), (2, "A b\tc d"), (None, "new words a b"), (3, None), (4, ""), (5, "x y z " * 50), (10, "x z z y unseen b a")],
    [(i, "the same few words again") for i in range(40)],
    [],
])
def test_cases(spark, docs):
    check(spark, docs, sums=True)


def test_no_training_rows(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    check(spark, [(held, "only held out")])


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs)


def test_rare_words_and_hot_contexts(spark, monkeypatch):
    import seqlab.llm.katz as katz

    monkeypatch.setattr(katz, "FREQUENT", 50)
    monkeypatch.setattr(katz, "CHUNK_TEXTS", 100)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300).collect()]
    check(spark, docs)
