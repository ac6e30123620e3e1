"""WARC archives with revisit records, and an external merge of their capture indexes.

Records are written as runs: every task sorts its captures by URL key and time and writes one archive.
Reading an archive back gives one index run, sorted like it. The index is then merged externally: the key
space is cut into ranges, each run is cut at the range bounds, and the pieces of one range meet in a task
where a loser tree merges them. A piece is a few columns of numbers and short texts. Ranges are cut by URL
key, time and page together, so captures of one URL may fill many ranges.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.staging import shared_folder, staged, width

SMALL_PAYLOAD = 100
SALTS = 8
RECORDS_PER_ARCHIVE = 2_000
END_OF_RECORD = "\r\n\r\n"
#: Capture time of page n: n minutes (modulo ten years) after 2024-01-01.
FIRST_CAPTURE, CAPTURE_MINUTES = 1_704_067_200, 5_256_000

_ENTRY = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url_key string, captured string, archive string, offset bigint"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the top down, then path and query, all in lower case."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(plain, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(plain, r"^[a-z][a-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def with_record_types(pages: DataFrame) -> DataFrame:
    """Add digest, size, record type and referred page.

    Only digests that occur twice are joined back; both sides are salted, since one payload may be a third
    of all rows.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # written once: both sides of the join below must see the same numbers, whatever order the input comes in
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    # nulls order last: a page without an id is a response only among its like
    least = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id"), F.col("row")))
    shared = rows.where(F.col("size") >= SMALL_PAYLOAD).groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = staged(shared.select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")))
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(shared, ["digest", "salt"], "left")
    revisit = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    return joined.select("page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first_page")).alias("refers_to"))


def record_text(df: DataFrame) -> Column:
    """One WARC record without its closing line ends, which the writer adds."""
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    minutes = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CAPTURE_MINUTES))
    captured = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + minutes * 60)
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    # a line break in a URL would end the header
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.date_format(F.convert_timezone(None, F.lit("UTC"), captured.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")), line("WARC-Target-URI", url), line("WARC-URL-Key", F.regexp_replace("url_key", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("record_type") == "revisit", line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(body).cast("string")))
    return F.concat(head, F.lit(END_OF_RECORD), body)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped WARC files, each a run sorted by URL key and time."""
    typed = with_record_types(pages).withColumn("url_key", url_key(F.col("url")))
    runs = typed.sortWithinPartitions("url_key", "page_id")
    runs.select(record_text(runs).alias("value")).write.option("lineSep", END_OF_RECORD).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


_HEADER = re.compile(rb"^([A-Za-z-]+): (.*)$", re.M)


def _records(content: bytes):
    """(offset, headers, payload) of the records of one archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        headers = {k.decode(): v.decode() for k, v in _HEADER.findall(content[at:end].replace(b"\r\n", b"\n"))}
        body = end + 4
        stop = body + int(headers["Content-Length"])
        yield at, headers, content[body:stop]
        at = stop + 4


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_index(df_archives: DataFrame) -> DataFrame:
    """Index entries of archives (rows of the binary file source), in record order within an archive.

    Digest and size of responses are taken from the payload that was read, those of revisits from the header.
    """
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for offset, head, payload in _records(gzip.decompress(content.as_buffer())):
                    whole = head["WARC-Type"] == "response"
                    rows.append((_page(head["WARC-Record-ID"]), len(payload) if whole else int(head["WARC-Payload-Length"]),
                                 hashlib.sha256(payload).hexdigest() if whole else head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"],
                                 _page(head.get("WARC-Refers-To")), head["WARC-URL-Key"], head["WARC-Date"], name.rsplit("/", 1)[-1], offset))
                yield _batch(rows)

    return df_archives.select("path", "content").mapInArrow(run, _ENTRY)


def _batch(rows: list[tuple], extra: tuple = ()) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [tuple(f.split()) for f in _ENTRY.split(", ")] + list(extra)
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


class LoserTree:
    """Tournament of k sorted iterators: inner nodes keep losers, so one path is replayed for each row."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = len(self.runs)
        self.heads = [None] * self.k
        self.keys: list = [None] * self.k
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._advance(i)
        for i in range(self.k):
            self._replay(i, building=True)

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        # exhausted runs order last; the run number breaks ties
        self.keys[i] = (self.heads[i] is None, self.key(self.heads[i]) if self.heads[i] is not None else (), i)

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0 and building:
                self.losers[node] = i
                return
            if self.keys[self.losers[node]] < self.keys[i]:
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k:
            winner = self.losers[0]
            if self.heads[winner] is None:
                return
            yield self.heads[winner]
            self._advance(winner)
            self._replay(winner)


def _order(row: tuple) -> tuple:
    """URL key, time, page (unknown pages last), then place."""
    return row[5], row[6], row[0] is None, row[0] or 0, row[7], row[8]


def merged_index(entries: DataFrame) -> DataFrame:
    """Entries of many sorted runs in one global order: adds ``history``, 0, 1, ... over all captures.

    Range bounds come from a sample of keys of fixed size; a bound is a whole key, so equal URLs may part.
    """
    ranges = width(entries)
    share = min(1.0, 50.0 * ranges / max(entries.count(), 1))
    marks = sorted(_order(tuple(r)[:9]) for r in entries.sample(share, seed=7).collect()) if ranges > 1 else []
    bounds = [marks[i * len(marks) // ranges] for i in range(1, ranges)] if marks else []

    def cut(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                yield row

    def label(batches):
        for batch in batches:
            rows = list(cut([batch]))
            part = [bisect.bisect_right(bounds, _order(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    def merge(table: pa.Table) -> pa.Table:
        runs: dict[str, list] = {}
        for row in zip(*[c.to_pylist() for c in table.columns]):
            runs.setdefault(row[7], []).append(row)
        # a run's rows may arrive in several blocks; their places restore its order
        for rows in runs.values():
            rows.sort(key=lambda r: r[8])
        rows = list(LoserTree(list(runs.values()), _order))
        out = [list(c) for c in zip(*rows)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, table.schema)] + [pa.array(range(len(rows)), pa.int64())],
                                    names=[*table.schema.names, "place"])

    cutted = entries.mapInArrow(label, f"{_ENTRY}, part int")
    merged = staged(cutted.groupBy("part").applyInArrow(merge, f"{_ENTRY}, part int, place bigint"))
    sizes = {r["part"]: r["n"] for r in merged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(ranges):
        before.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("part") + 1)
    return merged.withColumn("history", start + F.col("place")).drop("part", "place")


def archive_pages(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, archive, offset, history.

    Null html is an empty payload. Pages with equal payloads of at least 100 bytes revisit the one with the
    smallest id; of equal ids one row, whichever comes first in the input, is the response. A null id orders
    last. The table has no capture time: page n counts as captured n minutes into 2024. Other columns are
    ignored; an empty table gives no rows.
    """
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path)
    archives = pages.sparkSession.read.format("binaryFile").load(path, pathGlobFilter="*.gz")
    return merged_index(staged(read_index(archives)))
