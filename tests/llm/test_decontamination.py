import hashlib
import re

import pytest

from seqlab.llm.decontamination import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(len(ws) - 9, 1 if ws else 0)):
            windows.setdefault(tuple(ws[i:i + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                got = windows.get(tuple(ws[i:i + n]))
                if got:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in got if x is not None}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(found), digest, bool(hit)))
    return out


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id bigint, text string, n_words int, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, fp int")
    assert key(decontaminate(d, b).drop("text_key").collect()) == key(brute(docs, items))


LONG = " ".join(f"w{i}" for i in range(40))


@pytest.mark.parametrize("docs, items", [
    ([(1, "see " + " ".join(f"W{i}" for i in range(5, 17)) + " end"), (2, LONG), (2, LONG), (None, LONG), (3, None), (4, ""), (5, "a, b. c")],
     [(10, LONG), (2, LONG), (11, "A-B c"), (None, "w3 w4"), (12, None), (13, "!!"), (10, "same same same same same same same same same same same same")]),
    ([(6, "same " * 5000 + "é À"), (7, " ".join(f"w{i}" for i in range(9)))], [(1, "same " * 30), (2, "é"), (2, "À é")]),
    ([(1, "a b")], []),
    ([], [(1, "a b")]),
])
def test_cases(spark, docs, items):
    check(spark, docs, items)


def test_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert any(r[2] for r in brute(docs, items))
    check(spark, docs, items)
