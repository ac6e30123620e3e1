"""Phrases of two to four words by Toivonen's sampling method, scored by how tightly they hold together.

1. A sample of the documents proposes phrases: words and pairs at a lowered threshold, then triples whose two
   pairs were proposed.
2. One full pass counts every phrase that was proposed together with the negative border: phrases that were not
   proposed although their leading and their trailing part were. Both are exactly the phrases whose two parts
   are proposed, so proposals need to be known only as bitmaps; a false positive is one more exact count.
3. A border phrase that proves frequent is a failure: its extensions have not been counted. A further pass counts
   those, until no failure is left (at most one pass per length), so the result does not depend on the sample.

Counts move as (tag, leading part, trailing part, count), added up in the task and packed by bucket of the name; the
number of buckets grows with the text, so that one bucket is small. ``tag`` holds language and number of words. Phrases are named by 64-bit hashes built from
those of their parts, so every part of a frequent phrase, itself frequent, is found by its name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlab.llm.blobs import pack, runs, small, unpack
from seqlab.llm.staging import staged
from seqlab.llm.words import U64, Words, blocks, mix, signed

WORDS = 4
MIN_COUNT = 30
SAMPLE_SHARE = 0.25
#: bits of a bitmap for each of its members, within these bounds (8 MB at most)
BITS_EACH, MIN_BITS, MAX_BITS = 32, 16, 26
#: counts held in a task before they are added up and sent, and bytes of text for each bucket of counts
HELD, BUCKET_BYTES = 1 << 18, 4 << 20

_LETTERS = np.ones(256, dtype=bool)
_LETTERS[[32, *range(9, 14), *b".,;:!?"]] = False
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*range(10, 14), *b".,;:!?"]] = True
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_COUNTS = "tag long, pre long, suf long, a long, key long"
_COUNT_SCHEMA = pa.schema([(c, pa.int64()) for c in ("tag", "pre", "suf", "a", "key")])


def joined_key(pre: np.ndarray, suf: np.ndarray, size) -> np.ndarray:
    """Name of a phrase from those of its leading and trailing part, one word shorter each."""
    with np.errstate(over="ignore"):
        return mix(pre * _A + suf * _B + np.asarray(size, dtype=np.uint64))


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = (keys >> U64(64 - int(math.log2(len(bits) * 8)))).astype(np.int64)
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def key_bits(keys: DataFrame, log_bits: int) -> np.ndarray:
    """Bitmap of the long column ``key``; its size does not depend on the rows. Tasks send their used segments only."""
    segment = 1 << min(16, log_bits)

    def partial(batches):
        seen = np.zeros((1 << log_bits) // 8, dtype=np.uint8)
        for batch in batches:
            slots = (batch.column(0).to_numpy().view(np.uint64) >> U64(64 - log_bits)).astype(np.int64)
            np.bitwise_or.at(seen, slots >> 3, (128 >> (slots & 7)).astype(np.uint8))
        rows = seen.reshape(-1, segment // 8)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_pydict({"segment": pa.array(used, pa.int32()), "bits": pa.array([rows[i].tobytes() for i in used], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        joined = np.bitwise_or.reduce(np.stack([np.frombuffer(b, dtype=np.uint8) for b in table.column("bits").to_pylist()]), axis=0)
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([joined.tobytes()], pa.binary())})

    out = np.zeros(((1 << log_bits) // segment, segment // 8), dtype=np.uint8)
    parts = keys.select("key").mapInArrow(partial, "segment int, bits binary").groupBy("segment").applyInArrow(merge, "segment int, bits binary")
    for row in parts.collect():
        out[row["segment"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.reshape(-1)


class _Phrases:
    """Names of the phrases of a block of texts: ``key(k)`` and ``valid(k)`` by first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray):
        self.words = Words(data, offsets, _LETTERS)
        breaks = np.concatenate([[0], np.cumsum(_BREAKS[self.words.data])])
        text = self.words.text_of
        start, end = self.words.start, self.words.end
        self.together = (text[1:] == text[:-1]) & (breaks[start[1:]] == breaks[end[:-1]])
        self.tag = languages[text] & ~7
        with np.errstate(over="ignore"):
            self._keys = [mix(self.words.hashes() ^ (self.tag.view(np.uint64) * _A))]
        self._valid = [np.ones(len(text), dtype=bool)]

    def key(self, size: int) -> np.ndarray:
        while len(self._keys) < size:
            last = self._keys[-1]
            self._keys.append(joined_key(last[:-1], last[1:], len(self._keys) + 1) if len(last) else last)
        return self._keys[size - 1]

    def valid(self, size: int) -> np.ndarray:
        while len(self._valid) < size:
            last = self._valid[-1]
            self._valid.append(last[:-1] & self.together[len(self._valid) - 1:] if len(last) else last)
        return self._valid[size - 1]

    def strings(self, spots: np.ndarray, size: int) -> list[str]:
        raw, start, end = self.words.data, self.words.start, self.words.end
        return [b" ".join(raw[start[j]:end[j]].tobytes() for j in range(i, i + size)).decode("utf-8", "replace") for i in spots.tolist()]


def _narrow(documents: DataFrame) -> DataFrame:
    """Text and a hash of the language whose low three bits are free for the number of words."""
    return documents.select("text", F.xxhash64(F.coalesce("lang", F.lit("und"))).alias("language"))


def _phrase_blocks(batches):
    for rows, data, offsets in blocks(batches):
        yield _Phrases(data, offsets, rows.column("language").to_numpy())


def _merged(parts: list[tuple]) -> tuple:
    keys, tags, pre, suf, counts = (np.concatenate(c) for c in zip(*parts))
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return keys[first], tags[first], pre[first], suf[first], np.bincount(group, weights=counts).astype(np.int64)


def _counts(documents: DataFrame, buckets: int, least: int, sizes: tuple[int, ...], wanted) -> DataFrame:
    """(tag, pre, suf, a, key) of the phrases of ``sizes`` words that occur ``least`` times or more and for which
    ``wanted(size, keys of the leading, of the trailing parts)`` holds.

    Size 0 counts the words of a language (at any number), size 1 each word.
    """
    def scan(batches):
        held, size_held = [], 0

        def send():
            keys, tags, pre, suf, counts = _merged(held)
            held.clear()
            bucket = (keys % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, tags, pre, suf, counts = (c[order] for c in (bucket, tags, pre, suf, counts))
            first = runs(bucket)
            blobs = []
            for i, j in zip(first, np.append(first[1:], len(bucket))):
                kinds, kind = np.unique(tags[i:j], return_inverse=True)
                blobs.append(pack(kinds, small(kind), pre[i:j], suf[i:j], small(counts[i:j])))
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[first]), "data": pa.array(blobs, pa.binary())})

        for phrases in _phrase_blocks(batches):
            for size in sizes:
                if not len(phrases.tag):
                    continue
                if size == 0:
                    tags, counts = np.unique(phrases.tag, return_counts=True)
                    held.append((tags.view(np.uint64), tags, tags.view(np.uint64), np.zeros(len(tags), dtype=np.uint64), counts.astype(np.float64)))
                    continue
                keys, use = phrases.key(size), phrases.valid(size)
                pre, suf = (keys, np.zeros(len(keys), dtype=np.uint64)) if size == 1 else (phrases.key(size - 1)[:-1], phrases.key(size - 1)[1:])
                spots = np.flatnonzero(use)
                if size > 1:
                    spots = spots[wanted(size, pre[spots], suf[spots])]
                found, first, counts = np.unique(keys[spots], return_index=True, return_counts=True)
                at = spots[first]
                held.append((found, phrases.tag[at] | size, pre[at], suf[at], counts.astype(np.float64)))
                size_held += len(found)
            if size_held >= HELD:
                yield send()
                size_held = 0
        if held:
            yield send()

    def add_up(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("data").to_pylist():
            kinds, kind, pre, suf, counts = unpack(blob)
            tags = kinds[kind]
            size = tags & 7
            keys = np.where(size == 0, tags.view(np.uint64), np.where(size == 1, pre, joined_key(pre, suf, size)))
            parts.append((keys, tags, pre, suf, counts.astype(np.float64)))
        keys, tags, pre, suf, counts = _merged(parts)
        keep = (counts >= least) | (tags & 7 == 0)
        return pa.Table.from_arrays([pa.array(c[keep]) for c in (tags, signed(pre), signed(suf), counts, signed(keys))], schema=_COUNT_SCHEMA)

    return _narrow(documents).mapInArrow(scan, "bucket int, data binary").groupBy("bucket").applyInArrow(add_up, _COUNTS)


def _size(tag: str = "tag") -> Column:
    return F.col(tag).bitwiseAND(7)


def _bits_for(keys: DataFrame, each: int = BITS_EACH) -> np.ndarray:
    return key_bits(keys, min(max(MIN_BITS, math.ceil(math.log2(each * keys.count() + 1))), MAX_BITS))


def frequent_phrases(documents: DataFrame, min_count: int = MIN_COUNT, share: float = SAMPLE_SHARE) -> tuple[DataFrame, int]:
    """((tag, pre, suf, a, key) of all phrases of up to four words with ``min_count`` occurrences or more, number of further passes).

    Includes the words (size 1) and the number of words of each language (size 0).
    """
    spark: SparkSession = documents.sparkSession
    send = spark.sparkContext.broadcast
    if share >= 1:
        sample, lowered = documents, min_count
    else:
        sample = documents.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
        lowered = max(1, math.ceil(share * min_count - 1.65 * math.sqrt(share * min_count)))
    buckets = -(-int(documents.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BUCKET_BYTES)
    few = max(1, int(buckets * min(share, 1)))
    proposed = staged(_counts(sample, few, lowered, (1, 2), lambda size, pre, suf: np.ones(len(pre), dtype=bool)))
    known = {k: _bits_for(proposed.where(_size() == k)) for k in (1, 2)}
    pairs = send(known[2])
    triples = staged(_counts(sample, few, lowered, (3,), lambda size, pre, suf: in_bits(pairs.value, pre) & in_bits(pairs.value, suf)))
    known[3] = _bits_for(triples)
    bits = send(known)
    passed = lambda size, pre, suf: in_bits(bits.value[size - 1], pre) & in_bits(bits.value[size - 1], suf)
    found = fresh = staged(_counts(documents, buckets, min_count, (0, 1, 2, 3, 4), passed))
    passes = 0
    while True:
        failed = _missing(fresh, bits)
        extra = {k: failed.where(_size() == k) for k in (1, 2, 3)}
        if not failed.limit(1).count():
            return found, passes
        wider = {k: known[k] | key_bits(extra[k], int(math.log2(len(known[k]) * 8))) for k in known}
        more = send(wider)
        was, now = bits, more

        def uncounted(size, pre, suf, was=was, now=now):
            old, new = was.value[size - 1], now.value[size - 1]
            return in_bits(new, pre) & in_bits(new, suf) & ~(in_bits(old, pre) & in_bits(old, suf))

        fresh = staged(_counts(documents, buckets, min_count, (2, 3, 4), uncounted))
        found, known, bits, passes = found.unionByName(fresh), wider, more, passes + 1


def _missing(counted: DataFrame, bits) -> DataFrame:
    """Frequent phrases of one to three words that were not proposed: failures of the border."""
    def look(batches):
        for batch in batches:
            size = batch.column("tag").to_numpy() & 7
            keys = batch.column("key").to_numpy().view(np.uint64)
            out = np.zeros(len(keys), dtype=bool)
            for k in (1, 2, 3):
                mine = size == k
                out[mine] = ~in_bits(bits.value[k], keys[mine])
            yield batch.filter(pa.array(out))

    rows = counted.select("tag", "key").where(_size().between(1, 3)).mapInArrow(look, "tag long, key long")
    return staged(rows)


def scored_phrases(found: DataFrame, longer_percent: int = 80) -> DataFrame:
    """(tag, key, a, l, r, score, k): phrases of two or more words with their lowest-scoring cut (ties: the first), less those
    that a longer frequent phrase holds and that occur outside it too seldom."""
    level = {k: found.where(_size() == k) for k in range(1, WORDS + 1)}
    words = level[1].select(F.col("key").alias("key"), F.col("a").alias("a"))

    def both(size: int, parts: DataFrame) -> DataFrame:
        pre = parts.select(*[F.col(c).alias(f"pre_{c}" if c != "key" else "pre") for c in parts.columns])
        suf = parts.select(*[F.col(c).alias(f"suf_{c}" if c != "key" else "suf") for c in parts.columns])
        return level[size].join(pre, "pre").join(suf, "suf")

    two = staged(both(2, words).select("tag", "key", "pre", "suf", "a", F.col("pre_a").alias("first"), F.col("suf_a").alias("last")))
    three = staged(both(3, two.drop("tag")).select("tag", "key", "pre", "suf", "a", F.col("pre_first").alias("first"), F.col("suf_last").alias("last"),
                                                    F.col("pre_a").alias("first2"), F.col("suf_a").alias("last2")))
    names = three.select("key", F.col("pre").alias("p"), F.col("suf").alias("s"), "a", "first", "last", "first2", "last2")
    four = staged(both(4, names))
    cut = lambda k, l, r: F.struct(F.expr(f"(cast(2000000 as decimal(38,0)) * a) div (cast({l} as decimal(38,0)) + {r})").alias("score"), F.lit(k).alias("k"),
                                   F.col(l).alias("l"), F.col(r).alias("r"))
    cuts = {2: (two, [cut(1, "first", "last")]), 3: (three, [cut(1, "first", "last2"), cut(2, "first2", "last")]),
            4: (four, [cut(1, "pre_first", "suf_a"), cut(2, "pre_first2", "suf_last2"), cut(3, "pre_a", "suf_last")])}
    scored = None
    for frame, options in cuts.values():
        part = frame.select("tag", "key", "a", F.array_min(F.array(*options)).alias("c")).select("tag", "key", "a", "c.l", "c.r", "c.score", "c.k")
        scored = part if scored is None else scored.unionByName(part)
    inside = three.select(F.explode(F.array("pre", "suf")).alias("key"), "a").unionByName(
        four.select(F.explode(F.array("pre", "suf", "pre_p", "pre_s", "suf_s")).alias("key"), "a"))
    longest = inside.groupBy("key").agg(F.max("a").alias("_longer"))
    return scored.join(longest, "key", "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < longer_percent * F.col("a"))).drop("_longer")


def _strings(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, phrase) of the phrases in ``keys`` and of a few others."""
    bits = documents.sparkSession.sparkContext.broadcast(_bits_for(keys, 4096))

    def scan(batches):
        sent: set[int] = set()
        for phrases in _phrase_blocks(batches):
            for size in range(2, WORDS + 1):
                spots = np.flatnonzero(phrases.valid(size))
                names = phrases.key(size)[spots]
                hit = in_bits(bits.value, names)
                names, first = np.unique(names[hit], return_index=True)
                new = [i for i, name in enumerate(names.tolist()) if name not in sent]
                sent.update(names.tolist())
                if new:
                    texts = phrases.strings(spots[hit][first[new]], size)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(names[new])), pa.array(texts)], names=["key", "phrase"])

    return _narrow(documents).mapInArrow(scan, "key long, phrase string").groupBy("key").agg(F.min("phrase").alias("phrase"))


def mine_phrases(documents: DataFrame, top: int = 2000, min_count: int = MIN_COUNT, longer_percent: int = 80, share: float = SAMPLE_SHARE) -> DataFrame:
    """The first ``top`` phrases of each language by score, then count, then phrase (byte order):
    lang, rank, phrase, a (its count), l, r (counts of the parts of its lowest-scoring cut), n (words of the language), score.

    Only doc_id, text and lang are read. A null text counts as an empty one, a null lang as 'und'; repeated rows count
    each; texts without words and an empty table give no rows. Ties of score and count at the end are settled by phrase.
    """
    found, _ = frequent_phrases(documents, min_count, share)
    scored = staged(scored_phrases(found, longer_percent))
    # the best of parts of a language first, with all ties, so that no task ranks a whole language
    order = [F.col("score").desc(), F.col("a").desc()]
    part = F.pmod("key", F.lit(64))
    few = scored.withColumn("_r", F.rank().over(Window.partitionBy("tag", part).orderBy(*order))).where(F.col("_r") <= top)
    language = F.col("tag").bitwiseAND(~7).alias("language")
    few = few.withColumn("language", language)
    few = staged(few.withColumn("_r", F.rank().over(Window.partitionBy("language").orderBy(*order))).where(F.col("_r") <= top).drop("_r"))
    texts = _strings(documents, few)
    names = documents.select(F.coalesce("lang", F.lit("und")).alias("lang")).distinct().withColumn("language", F.xxhash64("lang").bitwiseAND(~7))
    sizes = found.where(_size() == 0).select(language, F.col("a").alias("n"))
    rows = few.join(texts, "key").join(names, "language").join(sizes, "language")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS ws FROM p),
sizes AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, k, a, j, array_to_string(ws[1:j], ' ') AS lp, array_to_string(ws[j + 1:k], ' ') AS rp FROM (
  SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, (2000000::HUGEINT * cuts.a) // (x.a + y.a) AS score, j
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
subs AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (
  SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN subs USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000"""
