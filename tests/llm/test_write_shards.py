"""Shard files hold the documents: every row once, null and repeated ids included."""

from collections import Counter

import pytest

from seqlab.llm.sharding import write_shards

DOCS = "doc_id bigint, text string, lang string, source string, slot int, row string"
ROWS = [(1, "a b", "en", "s", 7, "r"), (1, "a b", "en", "s", 7, "r"), (1, "c", "de", "s", 8, "r"), (None, "d", None, None, 9, None), (None, None, "en", "t", None, None), (2, "", "el", "u", 1, "q")]


@pytest.mark.parametrize("rows", [ROWS, ROWS * 20])
def test_write_shards(spark, tmp_path, rows):
    path = str(tmp_path / "shards")
    write_shards(spark.createDataFrame(rows, DOCS), path, 4)
    got = spark.read.schema(DOCS + ", shard int").parquet(path).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 1
