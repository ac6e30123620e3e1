"""Operators that number rows give the same result on an input whose order is not fixed."""

from pyspark.sql import functions as F

from seqlab.llm.url_lists import list_entries, page_captures, temporal_list_join
from seqlab.llm.warc import archive_pages, with_record_types

PAGES = "/root/testdata/sf0.01/pages.parquet"


def _copies(spark):
    """Every page, each third one a second time under a new id."""
    pages = spark.read.parquet(PAGES)
    return pages.unionByName(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100000))


def test_archives_of_a_shuffled_input(spark):
    pages = _copies(spark)
    rows = pages.collect()
    first = {}
    for r in rows:
        if len(r.html.encode()) >= 100:
            first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    expected = sorted((r.page_id, "response" if first.get(r.html, r.page_id) == r.page_id else "revisit",
                       None if first.get(r.html, r.page_id) == r.page_id else first[r.html]) for r in rows)
    assert sum(e[1] == "revisit" for e in expected) > 50
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in archive_pages(pages.repartition(7)).collect())
    assert got == expected


def test_one_of_equal_rows_is_the_response(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200)] * 6, "page_id long, url string, html string").repartition(3)
    assert sorted(r.record_type for r in with_record_types(pages).collect()) == ["response"] + ["revisit"] * 5


def test_lists_on_a_shuffled_input(spark):
    pages = spark.read.parquet(PAGES)
    captures, entries = page_captures(pages), list_entries(pages)
    plain = sorted(map(tuple, temporal_list_join(captures, entries).collect()), key=repr)
    assert sorted(map(tuple, temporal_list_join(captures.repartition(7), entries).collect()), key=repr) == plain
