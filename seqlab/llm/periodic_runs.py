"""Periodic runs of words: difference-cover longest common extensions drive a harmonic grid of periods.

A run is a stretch of words with smallest period q and at least ``max(min_length, min_exponent * q)`` words that
neither neighbour extends. A run of period p and four periods holds four neighbouring multiples of p, so only
grid points p, 2p, 3p, ... whose words agree are followed: the grid of all periods costs n + n/2 + n/3 + ...
Each is extended to both sides by a longest common extension (LCE). Only the suffixes that start in a difference
cover modulo 7 are sorted; two positions reach a pair of such suffixes within six words, and a range minimum over
the neighbours' common prefixes gives the rest. Words are compared by 64-bit hashes.

Texts are independent, so the job is one pass without a shuffle; memory follows the largest of a block of
about 2 MB and the longest single text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.words import NOT_SPACE, Words, blocks

MIN_LENGTH = 6
MIN_EXPONENT = 4
COVER = (0, 1, 3)  # all differences modulo 7 occur between these
MODULUS = 7

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = range(len(COVER))
#: _SHIFT[i, j]: fewest words to go on until i and j (modulo 7) are both in the cover
_SHIFT = np.array([[next(d for d in range(MODULUS) if _SLOT[(i + d) % MODULUS] >= 0 and _SLOT[(j + d) % MODULUS] >= 0)
                    for j in range(MODULUS)] for i in range(MODULUS)])


class CoverLce:
    """Longest common extensions of ``words`` (integers; the last one occurs once)."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self.words = np.concatenate([words, np.full(2 * MODULUS, words.min() - 1, dtype=words.dtype)])
        groups = -(-self.size // MODULUS)
        self.places = (np.arange(groups)[:, None] * MODULUS + np.array(COVER)).reshape(-1)
        self.places = self.places[self.places < self.size]
        self._sort()
        self._table()

    def _sort(self) -> None:
        """Ranks of the cover's suffixes by their first 7, 14, 28, ... words until all differ."""
        columns = [self.words[self.places + t] for t in range(MODULUS)]
        order = np.lexsort(columns[::-1])
        change = np.zeros(len(order), dtype=bool)
        for c in columns:
            change[1:] |= c[order[1:]] != c[order[:-1]]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(change)
        self.levels, step = [rank], len(COVER)
        while rank.max() + 1 < len(rank):
            later = np.zeros(len(rank), dtype=np.int64)
            later[:-step] = rank[step:] + 1
            _, rank = np.unique(rank * (len(rank) + 1) + later, return_inverse=True)
            self.levels.append(rank)
            step *= 2
        self.rank = rank
        self.order = np.empty(len(rank), dtype=np.int64)
        self.order[rank] = np.arange(len(rank))

    def _table(self) -> None:
        """Common prefixes of neighbours in suffix order, and their minima over 2, 4, 8, ... neighbours."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        same = np.zeros(len(a), dtype=np.int64)
        count = len(self.rank)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], len(COVER) << level
            inside = np.maximum(a, b) < count
            equal = np.zeros(len(a), dtype=bool)
            equal[inside] = rank[a[inside]] == rank[b[inside]]
            same[equal] += MODULUS << level
            a[equal] += step
            b[equal] += step
        self.levels = None
        left, right = self.places[self.order[:-1]] + same, self.places[self.order[1:]] + same
        same += self._word_by_word(left, right, np.full(len(left), MODULUS))
        self.minima, span = [same], 1
        while 2 * span <= len(same):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:len(last) - span], last[span:]))
            span *= 2

    def _word_by_word(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        same = np.zeros(len(i), dtype=np.int64)
        alive = np.ones(len(i), dtype=bool)
        for t in range(MODULUS):
            alive &= t < limit
            spots = np.flatnonzero(alive)
            if not len(spots):
                break
            alive[spots] = self.words[np.minimum(i[spots] + t, self.size)] == self.words[np.minimum(j[spots] + t, self.size + 1)]
            alive &= np.maximum(i, j) + t < self.size
            same += alive
        return same

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and from j on (i <> j, both inside)."""
        shift = _SHIFT[i % MODULUS, j % MODULUS]
        same = self._word_by_word(i, j, shift)
        on = np.flatnonzero((same == shift) & (np.maximum(i, j) + shift < self.size))
        a, b = i[on] + shift[on], j[on] + shift[on]
        ra = self.rank[a // MODULUS * len(COVER) + _SLOT[a % MODULUS]]
        rb = self.rank[b // MODULUS * len(COVER) + _SLOT[b % MODULUS]]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            pick = level == k
            row = self.minima[k]
            same[on[pick]] += np.minimum(row[low[pick]], row[high[pick] - (1 << k)])
        return same


def _grid(words: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of grid points whose word equals those one, two, ... ``exponent - 1`` periods on.

    Texts lie longest first in ``words``; text i ends before ``bounds[i]``, so each period sees a prefix only.
    """
    places, periods = [], []
    longest = int(lengths[0]) if len(lengths) else 0
    fits = np.searchsorted(-lengths, -exponent * np.arange(1, longest // exponent + 1), side="right")
    for period, texts in enumerate(fits, start=1):
        grid = words[:bounds[texts - 1]:period]
        equal = grid[1:] == grid[:-1]
        for _ in range(exponent - 2):
            equal = equal[1:] & equal[:-1][:len(equal) - 1] if len(equal) > 1 else equal[:0]
        hits = np.flatnonzero(equal)
        if len(hits):
            places.append(hits * period)
            periods.append(np.full(len(hits), period))
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, counts: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """(text, start, length, period) of every run, sorted; text i holds the next ``counts[i]`` of ``words``."""
    first = np.concatenate([[0], np.cumsum(counts)])
    texts = np.flatnonzero(counts >= max(min_length, exponent))
    texts = texts[np.argsort(-counts[texts], kind="stable")]

    def lay_out(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen texts with a word of its own before the first and after each, and the ends of the texts."""
        lengths = counts[chosen]
        ends = np.cumsum(lengths + 1) + 1
        out = np.full(int(ends[-1]), -1, dtype=np.int64)
        at = np.repeat(ends - 1 - lengths, lengths) + _ramp(lengths)
        out[at] = words[np.repeat(first[chosen], lengths) + _ramp(lengths)]
        gaps = np.concatenate([[0], ends - 1])
        out[gaps] = -2 - np.arange(len(gaps))
        return out, ends

    empty = np.zeros((0, 4), dtype=np.int64)
    if not len(texts):
        return empty
    laid, ends = lay_out(texts)
    place, period = _grid(laid, counts[texts], ends, exponent)
    owner = np.searchsorted(ends, place, side="right")
    inside = owner < len(texts)
    if not inside.any():
        return empty
    place, period, owner = place[inside], period[inside], owner[inside]
    # only texts with a candidate are sorted
    busy = np.unique(owner)
    begin = ends[owner] - 1 - counts[texts[owner]]
    laid, new_ends = lay_out(texts[busy])
    here = np.searchsorted(busy, owner)
    at = place - begin + new_ends[here] - 1 - counts[texts[owner]]
    keep = (at >= 1) & (at + period < len(laid) - 1) & (place >= begin)
    at, period = at[keep], period[keep]
    if not len(at):
        return empty
    ahead = CoverLce(laid)(at, at + period)
    back = CoverLce(laid[::-1].copy())(len(laid) - at, len(laid) - at - period)
    start, length = at - back, back + period + ahead
    long = length >= np.maximum(min_length, exponent * period)
    found = np.unique(np.stack([start[long], length[long], period[long]], axis=1), axis=0)
    # the smallest period of a stretch divides its other ones and was found as well
    if len(found):
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])
        found = found[new]
    text = np.searchsorted(new_ends, found[:, 0], side="right")
    source = texts[busy[text]]
    out = np.stack([source, found[:, 0] - (new_ends[text] - 1 - counts[source]), found[:, 1], found[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length, one after the other."""
    stops = np.cumsum(lengths)
    return np.arange(int(stops[-1]) if len(stops) else 0) - np.repeat(stops - lengths, lengths)


def _joined(words: Words, source: np.ndarray, kept: np.ndarray, plain: np.ndarray) -> list[bytes]:
    """Kept words of each text with one space between; texts in ``plain`` keep all words in their order."""
    data, first = words.data, words.first
    spaced = np.zeros(len(data) + 1, dtype=bool)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    spaced[words.end[words.end < np.repeat(words.offsets[1:], words.counts)]] = True
    spaced = spaced[:-1] & ~inside  # one separator after a word stays, as a space
    text = np.where(spaced, 32, data)[inside | spaced].astype(np.uint8)
    cuts = np.concatenate([[0], np.cumsum(inside | spaced)])[words.offsets]
    out = []
    raw = text.tobytes()
    for i in range(len(first) - 1):
        if plain[i]:
            out.append(raw[cuts[i]:cuts[i + 1]].rstrip(b" "))
            continue
        chosen = source[first[i]:first[i + 1]][kept[first[i]:first[i + 1]]]
        out.append(b" ".join([data[a:b].tobytes() for a, b in zip(words.start[chosen].tolist(), words.end[chosen].tolist())]))
    return out


def periodic_runs(documents: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  rewrite: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period of each run, by start and period) and collapsed,
    the text without the words that a run holds after its first period, words joined by one space.

    ``rewrite(doc_ids, counts)`` may name the word (numbered through the whole block) that stands at each place
    before runs are looked for. Only doc_id and text are read, so other columns may have any name. A null text
    counts as an empty one, texts without words have no runs and an empty ``collapsed``; repeated rows give one row
    each; a null id stays null. ``min_exponent`` is 2 or more.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent below 2")
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for rows, data, offsets in blocks(batches):
            words = Words(data, offsets, NOT_SPACE, lower=False)
            counts = words.counts
            ids = rows.column("doc_id")
            source = np.arange(len(words.start))
            if rewrite is not None:
                source = rewrite(ids.to_pylist(), counts)
            _, names = np.unique(words.hashes(), return_inverse=True)
            runs = find_runs(names[source], counts, min_length, min_exponent)
            begin = words.first[:-1][runs[:, 0]] + runs[:, 1]
            change = np.zeros(len(source) + 1, dtype=np.int64)
            np.add.at(change, begin + runs[:, 3], 1)
            np.add.at(change, begin + runs[:, 2], -1)
            kept = np.cumsum(change[:-1]) == 0
            plain = np.ones(len(counts), dtype=bool)
            plain[runs[:, 0]] = False
            plain[words.text_of[source != np.arange(len(source))]] = False
            per_text = np.searchsorted(runs[:, 0], np.arange(len(counts) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(_RUN))
            texts = pa.array(_joined(words, source, kept, plain), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(per_text), spans), texts],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    schema = f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return documents.select("doc_id", "text").mapInArrow(scan, schema)


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: first start, then period) and digests of all runs and of the text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("rest"), r["start"].alias("start"), r["period"].alias("period")))
    best = found.withColumn("_best", F.array_min(order))
    length = -F.col("_best.rest")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), length.alias("length"), F.col("_best.period").alias("period"),
        F.expr("(-_best.rest * 1000) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def planted_periods(doc_ids: list, counts: np.ndarray) -> np.ndarray:
    """The contract's rewriting: with h = crc32 of the decimal id, a tenth of the texts repeat p words from word a on."""
    import zlib

    first = np.concatenate([[0], np.cumsum(counts)])
    source = np.arange(int(first[-1]))
    for i, doc_id in enumerate(doc_ids):
        h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), int(counts[i])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[first[i] + a:first[i + 1]] = first[i] + a + np.arange(n - a) % p
    return source
