"""Mined phrases against brute force and SQL, at any sample; the defined small cases."""

import re
from collections import Counter

import duckdb
import pytest

from seqlab.llm.phrase_mining import ORACLE, frequent_phrases, mine_phrases

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, top, least, percent=80):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i:i + k])] += 1
    frequent = {p: c for p, c in f.items() if c >= least}
    out = {}
    for p, a in frequent.items():
        lang, w = p[0], p[1:]
        if len(w) < 2:
            continue
        score, _, l, r = min(((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))))
        holders = [c for q, c in frequent.items() if q[0] == lang and len(q) > len(p) and any(q[i:i + len(w)] == w for i in range(1, len(q) - len(w) + 1))]
        if not any(100 * c >= percent * a for c in holders):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("share", [1.0, 0.25, 0.001])
def test_equals_brute_force_whatever_the_sample(spark, share):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    expected = brute([tuple(r) for r in docs.collect()], 150, 4)
    assert len(expected) > 300 and {r[0] for r in expected} > {"en"}
    assert rows_of(mine_phrases(docs, 150, 4, share=share)) == expected


def test_border_failures_add_passes(spark):
    docs = spark.createDataFrame([(i, "one two three four", "en") for i in range(40)], SCHEMA)
    assert frequent_phrases(docs, 30, 1.0)[1] == 0
    found, passes = frequent_phrases(docs, 30, 1e-9)  # an empty sample proposes nothing
    assert passes == 3 and found.where("tag & 7 > 0").count() == 10


def test_query_equals_sql(spark):
    from seqlab.llm.queries import QUERIES

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = rows_of(QUERIES["op11_toivonen_phrases"](spark, "/root/testdata/sf0.001"))
    assert got == sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLE})").fetchall()) and got


def test_small_cases(spark):
    tie = "b a. a b. B\tA; x  y! x y\nx y, "
    rows = [(1, None, "en"), (2, "", None), (3, " .,\n", "en"), (4, tie, "en"), (4, tie, "en"), (None, tie, None), (5, tie, "und"), (6, "é è é è é è", "fr"), (7, "k " * 30000, "zz")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tag", "2 as key", "3 as a", "4 as language", "5 as phrase")
    for share in (1.0, 0.3):
        assert rows_of(mine_phrases(docs, 5, 2, share=share)) == brute(rows, 5, 2)
    assert rows_of(mine_phrases(docs.limit(0), 5, 2)) == []
