"""Benchmark decontamination by winnowing: fingerprint join, then extension of every hit.

Words of both sides are hashed in k-grams. In every run of ``w`` consecutive k-grams the smallest hash
(rightmost on ties) becomes a fingerprint, so two texts that share ``k + w - 1`` words share a
fingerprint at the same place of the shared span: no span of the window length is missed. Training and
test fingerprints are joined, and each hit is extended word by word to both sides; it counts if the
equal stretch reaches the window length. The comparison is on words, so hash collisions add nothing.
Test items with fewer words than a window are one window; for their few lengths every gram is looked up.

A fixed 2 MB bitmap of the test fingerprints thins the training side before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.staging import hash_bitmap, in_bitmap, staged
from seqlab.llm.words import ALNUM, SMALL_BLOCK_BYTES, Words, blocks, signed

SALTS = 8

_ANCHOR = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("need", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
_ANCHOR_DDL = "array<struct<fp: bigint, pos: int, need: int, before: array<string>, after: array<string>>>"


def winnow(hashes: np.ndarray, left: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the chosen k-grams, where ``left`` is the number of words to the end of the text."""
    starts = np.flatnonzero(left >= k + w - 1)
    if not len(starts):
        return starts
    best, chosen = hashes[starts], starts.copy()
    for step in range(1, w):
        value = hashes[starts + step]
        lower = value <= best
        best = np.where(lower, value, best)
        chosen[lower] = starts[lower] + step
    return np.unique(chosen)


def _anchors(words: Words, window: int, k: int, short: list[int], bits: np.ndarray | None, whole_short: bool) -> list[list[dict]]:
    """Per text: chosen fingerprints with their surroundings; with ``bits`` only those that test true."""
    left, text_of = words.left_in_text(), words.text_of
    out: list[list[dict]] = [[] for _ in words.counts]
    grams = words.grams(k)
    wanted = [(winnow(grams, left, k, window - k + 1), grams, window)]
    for n in short:
        gram = words.grams(n)
        at = np.flatnonzero(left >= n)
        if whole_short:
            at = at[words.counts[text_of[at]] == n]
        wanted.append((at, gram ^ np.uint64(n), n))
    for at, values, need in wanted:
        if bits is not None:
            at = at[in_bitmap(bits, values[at])]
        for p in at.tolist():
            t = text_of[p]
            low, high = words.first[t], words.first[t + 1]
            near = words.strings(max(low, p - (window - k)), p)[::-1] if need == window else []
            out[t].append({"fp": int(values[p:p + 1].view(np.int64)[0]), "pos": int(p - low), "need": need, "before": near,
                           "after": words.strings(p, min(high, p + need))})
    return out


def _fingerprinted(df: DataFrame, key: str, window: int, k: int, short: list[int], bits, whole_short: bool) -> DataFrame:
    def run(batches):
        for rows, data, offsets in blocks(batches, size=SMALL_BLOCK_BYTES):
            words = Words(data, offsets, ALNUM)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(words.counts, pa.int64()), pa.array(_anchors(words, window, k, short, bits, whole_short), pa.list_(_ANCHOR))],
                names=[key, "text_key", "n_words", "anchors"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.mapInArrow(run, f"`{key}` {kind}, text_key bigint, n_words bigint, anchors {_ANCHOR_DDL}")


def _equal_run(a: Column, b: Column) -> Column:
    """Length of the common prefix of two short arrays of words."""
    differs = F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(True)))
    first = F.array_position(differs, True)
    return F.when(first > 0, first - 1).otherwise(F.size(differs)).cast("int")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and no hits. Repeated rows each give a row. Items with a null id
    mark words but are not listed; repeated item ids count once. An empty benchmark gives no hits. A last
    column, text_key, is the xxhash64 of the text. Columns other than doc_id, item_id and text are ignored.
    """
    lengths = _fingerprinted(benchmark.where("text is not null"), "item_id", window, k, [], None, False).select("n_words")
    short = sorted(r[0] for r in lengths.where((F.col("n_words") > 0) & (F.col("n_words") < window)).distinct().collect())
    tests = _fingerprinted(benchmark, "item_id", window, k, short, None, True).select("item_id", F.explode("anchors").alias("a")).select("item_id", "a.*")
    tests = staged(tests.select("item_id", "fp", "need", "before", "after", F.md5(F.to_json(F.struct("fp", "need", "before", "after"))).alias("place")))
    bits = hash_bitmap(tests, "fp")

    found = _fingerprinted(documents, "doc_id", window, k, short, bits, False)
    found = staged(found.withColumn("row", F.monotonically_increasing_id()))
    hits = found.where(F.size("anchors") > 0).select("row", F.explode("anchors").alias("a")).select("row", "a.*")
    hits = hits.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    places = tests.select("fp", "need", F.col("before").alias("t_before"), F.col("after").alias("t_after"), "place").distinct()
    places = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = _equal_run(F.col("after"), F.col("t_after"))
    left = _equal_run(F.col("before"), F.col("t_before"))
    spans = hits.join(places, ["fp", "need", "salt"]).select("row", "pos", "need", "place", left.alias("left"), right.alias("right"))
    spans = staged(spans.where((F.col("right") >= F.least(F.lit(k), "need")) & (F.col("left") + F.col("right") >= F.col("need")))
                   .select("row", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.col("right") - 1).alias("last"), "place"))
    marked = (spans.select("row", "begin", "last").distinct().select("row", F.explode(F.sequence("begin", "last")).alias("word"))
              .distinct().groupBy("row").agg(F.count("*").alias("n_hit")))
    named = (spans.select("row", "place").distinct().join(tests.select("place", "item_id").distinct(), "place")
             .where("item_id is not null").select("row", F.col("item_id").cast("string").alias("item")).distinct())
    listed = named.groupBy("row").agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    joined = found.select("row", "doc_id", "text_key", "n_words").join(marked.join(listed, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                         F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "text_key")
