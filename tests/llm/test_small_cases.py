"""Nulls, empty and long texts, repeated rows, clashing names and empty tables, for operators without a module of their own."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqlab.llm.bpe import encode_documents
from seqlab.llm.mil_quality import classify_quality
from seqlab.llm.quality_rules import quality_rules
from seqlab.llm.sharding import hilbert_index, shard_documents
from seqlab.llm.toxicity import classify_toxicity
from seqlab.llm.url_lists import temporal_list_join
from seqlab.llm.warc import LoserTree, archive_pages

DOCS = "doc_id bigint, text string, lang string, source string, n_words string, position int, row string"
ROWS = [(1, "One two three. " * 4, "en", "a", "x", 1, "r"), (1, "One two three. " * 4, "en", "a", "x", 1, "r"), (None, None, None, None, None, None, None), (2, "", "de", "b", "", 2, ""),
        (3, "Σίσυφος ΟΔΟΣ <|endoftext|> don't 12  é́", "el", "c", "x", 3, "r"), (4, "word " * 60_000, "en", "a", "x", 4, "r")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


@pytest.mark.parametrize("rows", [ROWS, []])
def test_quality_rules(spark, rows):
    got = quality_rules(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    if rows:
        assert (by[1].n_words, by[1].n_repeat_words, by[1].base_failed) == (12, 12, True)
        assert (by[None].n_words, by[None].kept, by[2].base_failed) == (0, False, True)
        assert by[4].n_repeat_words == 60_000 and by[3].n_symbols == 4


@pytest.mark.parametrize("rows", [ROWS, []])
def test_shards(spark, rows):
    got = shard_documents(docs(spark, rows), 4).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert not rows or max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.size, r.text_crc32) for r in got if r.doc_id in (None, 2)} <= {(16, 0)}


def test_hilbert_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(hilbert_index(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("rows", [ROWS, []])
def test_bpe_equals_the_library(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, encode_documents(docs(spark, rows), path).collect()))) == sorted(map(repr, want))


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives(spark):
    same, html = "x" * 200, "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 9
    rows = [(5, "http://a.org/1", same), (3, "http://b.org/1", same), (None, None, same), (3, "http://b.org/1", same), (7, "http://a.org/1", "short"), (8, "http://a.org/1", "short"),
            (9, "http://a.org/é x", html), (10, "", None)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id bigint, url string, html string, size int, digest string")
    got = archive_pages(frame).collect()
    assert sorted(r.history for r in got) == list(range(len(rows)))
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got if r.payload_bytes == 200)
    assert kinds == [(-1, "revisit", 3), (3, "response", None), (3, "revisit", 3), (5, "revisit", 3)]
    by = {r.page_id: r for r in got}
    assert by[9].payload_digest == hashlib.sha256(html.encode()).hexdigest() and by[9].payload_bytes == len(html.encode())
    assert by[10].payload_bytes == 0 and by[7].record_type == by[8].record_type == "response"
    assert archive_pages(frame.limit(0)).count() == 0


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "HTTP://u@A.b.org:80/x/y", "2024-03-05"), (2, "http://a.b.org/x", "2024-04-01"), (3, None, "2024-03-05"), (4, "http://b.org", None), (5, "http://zb.org/", "2024-03-05"),
                                      (1, "HTTP://u@A.b.org:80/x/y", "2024-03-05")], "page_id bigint, url string, f string").selectExpr("*", "cast(f as timestamp) fetched", "1 as row")
    entries = spark.createDataFrame([("l", "domain", "b.org", "add", "2023-01-01"), ("l", "domain", "b.org", "remove", "2024-04-01"), ("m", "folder", "a.b.org/x", "add", "2024-03-05"),
                                     ("m", "folder", "a.b.org/x", "add", "2024-03-05"), ("n", "host", "a.b.org", "add", "2024-03-06"), (None, "host", "a.b.org", "add", "2024-01-01")],
                                    "list string, kind string, pattern string, action string, d string").selectExpr("list", "kind", "pattern", "action", "cast(d as date) at")
    got = sorted((r.page_id, r.n_active, r.active_lists) for r in temporal_list_join(captures, entries).collect())
    assert got == [(1, 2, "l,m"), (1, 2, "l,m"), (2, 2, "m,n"), (3, 0, ""), (4, 0, ""), (5, 0, "")]
    assert temporal_list_join(captures.limit(0), entries).count() == 0
    assert temporal_list_join(captures, entries.limit(0)).where("blocked").count() == 0


@pytest.mark.parametrize("rows", [ROWS, []])
@pytest.mark.parametrize("known", [[], [(1, 1, 0, "t"), (4, 0, 1, "t"), (None, 0, 1, "t"), (99, None, None, "t")]])
def test_classifiers(spark, rows, known):
    quality = classify_quality(docs(spark, rows), labels(spark, known)).collect()
    toxic = classify_toxicity(docs(spark, rows), labels(spark, known)).collect()
    assert len(quality) == len(toxic) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in quality)
    assert all(0 <= r.expected_severity <= 3 for r in toxic)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    documents, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = classify_quality(documents, known).where("held_out").join(known, "doc_id").selectExpr("avg(cast(predicted = quality as int)) a").first().a
    assert held > 0.97
    graded = classify_toxicity(documents, known.where("doc_id % 4 <> 0")).withColumnRenamed("toxic", "found").join(known.where("doc_id % 4 = 0"), "doc_id")
    row = graded.selectExpr("avg(if(toxic = 0, cast(found as int), null)) wrong", "avg(if(toxic = 1, cast(found as int), null)) caught").first()
    assert row.wrong < 0.02 and row.caught > 0.85
