"""Similarity joins and clustering of sequences.

Joins against known sequences take candidates from an inverted index over string segments, which loses no pair above the
threshold. Clusters compare blocks of sequences tile by tile; a tile sends the links that join its components, so a family
that holds a third of all rows never sends its own pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise, shuffle_width
from .matching import distinct_cap_sample
from .ranking import global_position


# --- identity ------------------------------------------------------------------------------------

def mean_identity(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Mean of 1 - distance / longer length over all pairs of at most n sampled distinct values.

    The sample size bounds the pairs: that is the definition of this report.
    """
    sample = materialise(distinct_cap_sample(df, column, n, seed))
    a, b = sample.select(F.col(column).alias("a")), sample.select(F.col(column).alias("b"))
    identity = 1.0 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).agg(
        F.count("*").alias("pairs"), F.avg(identity).alias("mean_identity"), (1 - F.avg(identity)).alias("diversity"))


def allowed_edits(length: Column, identity: float) -> Column:
    return F.floor(length * round(1.0 - identity, 9) + 1e-9).cast("int")


def _segments(df: DataFrame, identity: float) -> DataFrame:
    """Cut length ``l`` into edits + 1 even segments: adds ``i``, ``at`` (1-based start) and ``size``."""
    parts = allowed_edits(F.col("l"), identity) + 1
    cut = df.withColumn("parts", parts).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    start = F.floor((F.col("i") - 1) * F.col("l") / F.col("parts")).cast("int")
    end = F.floor(F.col("i") * F.col("l") / F.col("parts")).cast("int")
    return cut.withColumn("at", start + 1).withColumn("size", end - start)


def _token(text: Column) -> Column:
    return F.concat_ws("|", F.col("l").cast("string"), F.col("i").cast("string"), text)


def segment_index(sequences: DataFrame, identity: float) -> DataFrame:
    """(sequence, token) of the shorter side: its own segments."""
    cut = _segments(sequences.select("sequence", F.length("sequence").alias("l")), identity)
    return cut.select("sequence", _token(F.substring(F.col("sequence"), F.col("at"), F.col("size"))).alias("token"))


def segment_probes(sequences: DataFrame, identity: float) -> DataFrame:
    """(sequence, token) of the longer side: every substring that may equal a partner's segment.

    With t edits, one of the t + 1 segments of the shorter string survives unchanged. Counting the edits
    to its left and right bounds how far it can have moved, so only a few starts per segment are needed.
    """
    n = F.length("sequence")
    lengths = F.filter(F.sequence(F.greatest(F.lit(1), F.floor(n * identity).cast("int") - 1), n), lambda l: n - l <= F.floor(l * round(1.0 - identity, 9) + 1e-9))
    cut = _segments(sequences.select("sequence", F.explode(lengths).alias("l")), identity)
    shift, left, right = n - F.col("l"), F.col("i") - 1, F.col("parts") - F.col("i")
    low = F.greatest(F.lit(1), F.col("at") - left, F.col("at") + shift - right)
    high = F.least(n - F.col("size") + 1, F.col("at") + left, F.col("at") + shift + right)
    spots = cut.withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi").withColumn("_s", F.explode(F.sequence("_lo", "_hi")))
    return spots.select("sequence", _token(F.substring(F.col("sequence"), F.col("_s"), F.col("size"))).alias("token"))


def verified(pairs: DataFrame, identity: float) -> DataFrame:
    """Distinct pairs whose edit distance is at most (1 - identity) of the shorter one.

    The distance is taken inside the index join, before anything is shuffled: with its bound as a
    constant it stops after a few cells, which is cheaper than shuffling and deduplicating candidates.
    """
    limit = allowed_edits(F.least(F.length("a"), F.length("b")), identity)
    within = F.levenshtein("a", "b") <= limit
    for bound in range(10, -1, -1):
        within = F.when(limit == bound, F.levenshtein("a", "b", bound) >= 0).otherwise(within)
    return pairs.where(F.abs(F.length("a") - F.length("b")) <= limit).where(within).select("a", "b").distinct()


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest vertex name per component, by label spreading with pointer jumping.

    Every round is checkpointed to the shared folder; only whether a label changed reaches the driver.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(vertices.select(F.col("sequence").alias("v"), F.col("sequence").alias("c")))
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("_m"))
        lowered = labels.join(heard, labels["v"] == heard["a"], "left").select("v", F.least("c", F.coalesce("_m", "c")).alias("n"), "c")
        hop = labels.select(F.col("v").alias("_v"), F.col("c").alias("_c"))
        jumped = materialise(lowered.join(hop, F.col("n") == F.col("_v"), "left").select("v", F.least("n", F.coalesce("_c", "n")).alias("c"), F.col("c").alias("old")))
        changed = jumped.where("c <> old").limit(1).count()
        labels = jumped.select("v", "c")
        if not changed:
            return labels.select(F.col("v").alias("sequence"), F.col("c").alias("cluster_id"))


#: sequences of a block (about BLOCK_ROOT * sqrt(rows), within these limits) and its letters
BLOCK_ROOT, BLOCK_LEAST, BLOCK_MOST, BLOCK_LETTERS = 24, 1024, 1 << 16, 1 << 22
#: pairs whose sketches are compared at once, and pairs whose distance is taken at once
_PAIRS_AT_ONCE, _DISTANCES_AT_ONCE, _COLUMNS_AT_ONCE = 1 << 16, 1 << 14, 1 << 12
#: letters that are counted at once, and candidates of an index whose sketches are compared at once
_LETTERS_AT_ONCE, _CANDIDATES_AT_ONCE = 1 << 19, 1 << 17
#: tasks of several tiles for each partition of a shuffle, if there are so many tiles
_TASKS = 4
#: running sketches that a tile keeps
_KEPT_BYTES = 1 << 25
#: nanoseconds, about: a pair of sketches, a candidate of an index, a look into an index
_PAIR_COST, _CANDIDATE_COST, _LOOK_COST = 6, 12, 20


def _bit(rank, bits: int):
    """Bit of the member that is so frequent: the first seven eighths have one each, the others share the rest."""
    own = bits - bits // 8
    return np.where(rank < own, rank, own + rank % (bits // 8))


class _Tile:
    """Sequences of one tile: letters end to end, a 64-bit sketch of their letters and a 256-bit one of their bigrams.

    A sketch is the parity of the letters (bigrams) that fall on each bit, so two sketches differ in no more bits than the
    bags differ in members. Frequent members have a bit of their own.
    """

    def __init__(self, texts: list[str]):
        self.length = np.array([len(x) for x in texts], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        seen = np.bincount(codes) > 0
        kinds = int(seen.sum())
        self.letter = (np.cumsum(seen) - 1).astype(np.uint8 if kinds <= 256 else np.int32)[codes]
        self.classes = classes = min(max(kinds, 1), 64)
        counts = np.zeros((len(texts), classes), dtype=np.uint8 if self.length.max(initial=0) < 256 else np.int32)
        often = np.zeros(classes * classes, dtype=np.int64)
        for rows, letters in self._folded():
            owner = np.arange(len(letters))[:, None] * classes
            counts[rows] = np.bincount((owner + letters).ravel(), minlength=len(letters) * classes).reshape(-1, classes)
            often += np.bincount((letters[:, :-1] * classes + letters[:, 1:]).ravel(), minlength=len(often))
        # the second occurrence of a letter is another member than the first
        counts = np.ascontiguousarray(counts.T)
        members = [(int(np.count_nonzero(held)), k, held) for k in range(classes) for nth in range(min(int(counts[k].max(initial=0)), 64)) for held in [counts[k] > nth]]
        bits = np.zeros((64, len(texts)), dtype=bool)
        for rank, (_, _, held) in enumerate(sorted(members, key=lambda m: -m[0])):
            bits[_bit(rank, 64)] ^= held
        self.letters = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)[:, 0].copy()
        bit = np.empty(len(often), dtype=np.int64)
        bit[np.argsort(-often, kind="stable")] = _bit(np.arange(len(often)), 256)
        self.tokens = np.zeros((len(often), 2), dtype=np.uint64)
        place = _bit(np.argsort(np.argsort(-often, kind="stable")), 128)
        self.tokens[np.arange(len(often)), place >> 6] = np.uint64(1) << (place & 63).astype(np.uint64)
        lone = np.zeros((len(often), 4), dtype=np.uint64)
        lone[np.arange(len(often)), bit >> 6] = np.uint64(1) << (bit & 63).astype(np.uint64)
        self.bigrams = np.zeros((len(texts), 4), dtype=np.uint64)
        for rows, letters in self._folded():
            for spot in range(letters.shape[1] - 1):
                self.bigrams[rows] ^= lone[letters[:, spot] * classes + letters[:, spot + 1]]
        self.ran: dict[tuple[int, int], np.ndarray] = {}
        self.words, self.masks = kinds <= 64, None  # sequences that fit a word are compared by the places of their letters

    def _places(self, rows: np.ndarray) -> np.ndarray:
        """Places of each letter in sequences that fit a word, as bits; taken once for each sequence that is asked for."""
        if self.masks is None:
            self.masks, self.placed = np.zeros((len(self.length), self.classes), dtype=np.uint64), np.zeros(len(self.length), dtype=bool)
        rows, columns = np.unique(rows[~self.placed[rows]]), np.arange(64)
        self.placed[rows] = True
        step = _LETTERS_AT_ONCE // 64
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            spots = np.minimum(self.first[some, None] + columns, len(self.letter) - 1)
            letters = np.where(columns < self.length[some, None], self.letter[spots], 255)
            for k in range(self.classes):
                self.masks[some, k] = np.packbits(letters == k, axis=1, bitorder="little").view(np.uint64)[:, 0]
        return self.masks.reshape(-1)

    def matrix(self, begin: int, end: int) -> np.ndarray:
        """Letters of neighbouring sequences of one length."""
        size = int(self.length[begin]) if end > begin else 0
        at = int(self.first[begin]) if end > begin else 0
        return self.letter[at:at + size * (end - begin)].reshape(end - begin, size)

    def running(self, begin: int, end: int) -> np.ndarray:
        """128-bit sketches of the first 0, 1, ... bigrams of neighbouring sequences of one length, a row for each number."""
        if (begin, end) in self.ran:
            return self.ran[begin, end]
        letters = np.ascontiguousarray((self.matrix(begin, end) % 64).T)
        out = np.zeros((max(len(letters), 1), end - begin, 2), dtype=np.uint64)
        for spot in range(len(letters) - 1):
            np.bitwise_xor(out[spot], self.tokens[letters[spot].astype(np.int64) * self.classes + letters[spot + 1]], out=out[spot + 1])
        if out.nbytes + sum(x.nbytes for x in self.ran.values()) <= _KEPT_BYTES:  # short runs meet several others
            self.ran[begin, end] = out
        return out

    def _folded(self):
        """(rows, letters in at most 64 classes) of runs of sequences of one length."""
        ends = np.flatnonzero(np.append(self.length[1:] != self.length[:-1], True))[:len(self.length)] + 1
        begin = 0
        for end in ends.tolist():
            step = max(1, _LETTERS_AT_ONCE // max(int(self.length[begin]), 1))
            for at in range(begin, end, step):
                yield slice(at, min(at + step, end)), self.matrix(at, min(at + step, end)).astype(np.int64) % 64
            begin = end

    def within(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Is the edit distance of each pair at most its limit?"""
        swap = self.length[a] > self.length[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), dtype=bool)
        short = self.length[a] <= 64 if self.words else np.zeros(len(a), dtype=bool)
        out[short] = self._within_word(a[short], b[short], limit[short])
        rest = np.flatnonzero(~short)
        step = max(1, (1 << 20) // (int(self.length.max(initial=0)) + 1))
        for at in range(0, len(rest), step):
            part = rest[at:at + step]
            out[part] = self._distance(a[part], b[part]) <= limit[part]
        return out

    def _within_word(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Bit-parallel distance, one column of the table per step; pairs leave at their end, or once they can't end within the limit."""
        out = np.zeros(len(a), dtype=bool)
        one = np.uint64(1)
        empty = self.length[a] == 0
        out[empty] = self.length[b[empty]] <= limit[empty]
        row = np.flatnonzero(~empty)
        masks = self._places(a[row])
        row = row[np.argsort(self.length[b[row]], kind="stable")]
        for begin in range(0, len(row), _COLUMNS_AT_ONCE):
            mine = row[begin:begin + _COLUMNS_AT_ONCE]
            size, spot, mask = self.length[b[mine]], self.first[b[mine]], a[mine] * self.classes
            inside = ~np.uint64(0) >> (64 - self.length[a[mine]]).astype(np.uint64)  # a letter each
            up, down = np.full(len(mine), ~np.uint64(0)), np.zeros(len(mine), dtype=np.uint64)
            cost = lambda up, down, inside: step + np.bitwise_count(up & inside).astype(np.int64) - np.bitwise_count(down & inside)
            step = 0
            while len(mine):
                done = int(np.searchsorted(size, step, side="right"))
                if done:
                    out[mine[:done]] = cost(up[:done], down[:done], inside[:done]) <= limit[mine[:done]]
                    mine, size, spot, mask, inside, up, down = (x[done:] for x in (mine, size, spot, mask, inside, up, down))
                if step % 4 == 3:
                    stay = cost(up, down, inside) - (size - step) <= limit[mine]
                    if np.count_nonzero(stay) < 0.9 * len(stay):
                        mine, size, spot, mask, inside, up, down = (x[stay] for x in (mine, size, spot, mask, inside, up, down))
                if not len(mine):
                    break
                equal = masks[mask + self.letter[spot + step]]
                vertical = equal | down
                across = equal & up
                across += up
                across ^= up
                across |= equal
                rise = ~(across | up)
                rise |= down
                across &= up  # where the row falls
                rise <<= one
                rise |= one
                across <<= one
                down = rise & vertical
                vertical |= rise
                np.invert(vertical, out=vertical)
                vertical |= across
                up = vertical
                step += 1
        return out

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distance of any pairs, row by row of the table; ``a`` is the shorter one."""
        width = int(self.length[b].max(initial=0))
        columns = np.arange(width + 1)
        end = max(len(self.letter) - 1, 0)
        text = self.letter[np.minimum(self.first[b][:, None] + columns[None, :width], end)]
        before = np.repeat(columns[None], len(a), axis=0)
        for i in range(int(self.length[a].max(initial=0))):
            here = self.letter[np.minimum(self.first[a] + i, end)]
            row = np.empty_like(before)
            row[:, 0] = i + 1
            row[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + (text != here[:, None]))
            row = np.minimum.accumulate(row - columns, axis=1) + columns
            before = np.where((i < self.length[a])[:, None], row, before)
        return before[np.arange(len(a)), self.length[b]]


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest members of components after the links (a, b) are added."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root = higher


def _room(pairs: int) -> tuple[np.ndarray, ...]:
    return np.empty(pairs, dtype=np.uint64), np.empty(pairs, dtype=np.uint8), np.empty(pairs, dtype=bool)


def _windows(la: int, lb: int, edits: int):
    """(segment, its first letter, size, first letters in the other text): a text of ``lb`` letters within ``edits`` of one of ``la <= lb`` letters holds
    one of the edits + 1 even segments of the shorter, unchanged, at one of these places.

    Count the edits before segment i less i: this starts at 0, ends below 0 and falls by 1 at most, and only past a segment without edits. So
    there is a segment i without edits that has i edits before it and at most edits - i after it.
    """
    more, parts = lb - la, edits + 1
    for i in range(parts):
        at, size = i * la // parts, (i + 1) * la // parts - i * la // parts
        low = max(at - i, at + more - (edits - i), 0)
        high = min(at + i, at + more + (edits - i), lb - size)
        if low <= high:
            yield i, at, size, range(low, high + 1)


def _hashed(letters: np.ndarray, at: int, size: int, bits: int) -> np.ndarray:
    """Hashes, in so many bits, of a part of each row; equal parts have equal hashes."""
    key = np.zeros(len(letters), dtype=np.uint64)
    for spot in range(at, at + size):
        key += letters[:, spot]
        key += np.uint64(1)
        key *= np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - bits)).astype(np.uint16)


def _beside(running: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of the bigrams before a part and after it."""
    return running[max(at - 1, 0)], running[-1] ^ running[min(end, len(running) - 1)]


class _Segments:
    """Index of the even segments of sequences of one length: members of each hash of a segment stand together."""

    def __init__(self, tile: _Tile, begin: int, end: int, edits: int):
        letters, running = tile.matrix(begin, end), tile.running(begin, end)
        self.size, self.edits = letters.shape[1], edits
        self.bits = min(max(int(len(letters)).bit_length() + 3, 8), 16)
        self.lists = []
        for i in range(edits + 1):
            at, stop = i * self.size // (edits + 1), (i + 1) * self.size // (edits + 1)
            key = _hashed(letters, at, stop - at, self.bits)
            order = np.argsort(key, kind="stable").astype(np.int32)
            starts = np.append(0, np.cumsum(np.bincount(key, minlength=1 << self.bits))).astype(np.int32)
            self.lists.append((starts, order, tile.letters[begin:end][order], *(x[order] for x in _beside(running, at, stop))))

    def looks(self, size: int) -> int:
        return sum(len(places) for *_, places in _windows(self.size, size, self.edits))

    def candidates(self, letters: np.ndarray) -> list[tuple]:
        """(segment, its first letter, its end, place, rows, first place in its list, members there) for sequences of one length that is not shorter."""
        out = []
        for i, at, size, places in _windows(self.size, letters.shape[1], self.edits):
            starts = self.lists[i][0]
            for place in places:
                key = _hashed(letters, place, size, self.bits)
                low = starts[key]
                many = starts[key.astype(np.int32) + 1] - low
                rows = np.flatnonzero(many)
                out.append((i, at, at + size, place, rows.astype(np.int32), low[rows], many[rows]))
        return out

    def near(self, found: list[tuple], sketches: np.ndarray, running: np.ndarray):
        """Yields (member, row) of candidates that the sketches of all letters and those of the bigrams on either side of the segment allow."""
        more = len(running) - self.size
        for i, at, stop, place, rows, low, many in found:
            _, order, mine, before, after = self.lists[i]
            left, right = _beside(running, place, place + stop - at)
            # t edits change at most t letters and 2t bigrams of the longer one
            most, shift = 2 * self.edits - more, place - at
            most_left, most_right = 4 * i - abs(shift), 4 * (self.edits - i) - abs(more - shift)
            ends = np.cumsum(many, dtype=np.int64)
            begin = 0
            while begin < len(rows):
                skipped = int(ends[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, skipped + _CANDIDATES_AT_ONCE, side="right")))
                each, upto, some = many[begin:end], ends[begin:end] - skipped, rows[begin:end]
                member = np.arange(int(upto[-1]), dtype=np.int32)
                member += np.repeat(low[begin:end] - (upto - each).astype(np.int32), each)
                differ = mine[member]
                differ ^= np.repeat(sketches[some], each)
                kept = np.flatnonzero(np.bitwise_count(differ) <= most)
                row, member = np.repeat(some, each)[kept], member[kept]
                for one, other, limit in ((before, left, most_left), (after, right, most_right)):
                    differ = np.bitwise_count(one[member] ^ other[row])
                    kept = np.flatnonzero(differ[:, 0] + differ[:, 1] <= limit)
                    row, member = row[kept], member[kept]
                yield order[member], row
                begin = end


def linked_members(one: list[str], two: list[str] | None, identity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member of its component), positions in ``one + two``, by links between the sides or, without ``two``, inside ``one``.

    Both lists are sorted by length and hold no text twice. Sequences of two lengths meet in numpy: by an index of segments that loses no pair, or
    all with all where that is less work. Sketches of letters leave few of them, sketches of bigrams fewer, and members of one component need no
    distance. At most one row per member comes back, whatever the links.
    """
    tile = _Tile(one if two is None else one + two)
    root = np.arange(len(tile.length))
    per_edit = round(1.0 - identity, 9)

    def groups(begin: int, end: int) -> list[tuple[int, int, int]]:
        sizes, first = np.unique(tile.length[begin:end], return_index=True)
        return list(zip(sizes.tolist(), (first + begin).tolist(), [*(first[1:] + begin).tolist(), end]))

    sides = [groups(0, len(one))] if two is None else [groups(0, len(one)), groups(len(one), len(tile.length))]
    held, waiting = [], 0
    room = _room(_PAIRS_AT_ONCE)

    def settle() -> None:
        nonlocal root, held, waiting
        if not held:
            return
        a, b, limit = (np.concatenate(x) for x in zip(*held))
        held, waiting = [], 0
        _, once = np.unique(a * len(root) + b, return_index=True)
        a, b, limit = a[once], b[once], limit[once]
        for at in range(0, len(a), _DISTANCES_AT_ONCE):
            x, y, most = a[at:at + _DISTANCES_AT_ONCE], b[at:at + _DISTANCES_AT_ONCE], limit[at:at + _DISTANCES_AT_ONCE]
            apart = root[x] != root[y]
            x, y, most = x[apart], y[apart], most[apart]
            near = tile.within(x, y, most)
            root = _merge(root, x[near], y[near])

    def offer(a: np.ndarray, b: np.ndarray, edits: int, more: int, same: bool) -> None:
        """Pairs that sketches of letters left."""
        nonlocal waiting
        keep = (root[a] != root[b]) & (a < b) if same else root[a] != root[b]
        a, b = a[keep], b[keep]
        near = np.bitwise_count(tile.bigrams[a] ^ tile.bigrams[b]).sum(axis=1, dtype=np.int64) <= 4 * edits - more
        a, b = a[near], b[near]
        if len(a):
            held.append((a, b, np.full(len(a), edits)))
            waiting += len(a)
            if waiting >= _DISTANCES_AT_ONCE:
                settle()

    def all_pairs(first: tuple, second: tuple, edits: int, more: int, same: bool) -> None:
        nonlocal room
        (_, begin_a, end_a), (_, begin, end) = first, second
        sketches = tile.letters[begin:end]
        step = max(1, _PAIRS_AT_ONCE // (end - begin))
        for at in range(begin_a, end_a, step):
            upto = min(at + step, end_a)
            many = (upto - at) * (end - begin)
            if many > len(room[0]):  # one row of a long list
                room = _room(many)
            differ, counted, open_pairs = (x[:many].reshape(upto - at, end - begin) for x in room)
            np.bitwise_xor(tile.letters[at:upto, None], sketches[None, :], out=differ)
            np.bitwise_count(differ, out=counted)
            np.less_equal(counted, 2 * edits - more, out=open_pairs)
            a, b = np.divmod(np.flatnonzero(open_pairs), end - begin)
            offer(a + at, b + begin, edits, more, same)

    for n, side in enumerate(sides):
        for first in side:  # the shorter of a pair
            la, begin_a, end_a = first
            edits = int(np.floor(la * per_edit + 1e-9))
            if not edits:
                continue
            index = None
            for second in sides[n - 1] if len(sides) == 2 else side:
                lb, begin_b, end_b = second
                if lb < la or lb - la > edits or (n == 1 and lb == la):
                    continue
                # t edits change at most t letters and 2t bigrams of the longer one
                more, same, pairs = lb - la, first is second, (end_a - begin_a) * (end_b - begin_b)
                found = None
                if edits < la and (edits + 1) ** 2 * _LOOK_COST < 4 * (end_a - begin_a) * _PAIR_COST:
                    if index is None:
                        index = _Segments(tile, begin_a, end_a, edits)
                    if index.looks(lb) * (end_b - begin_b) * _LOOK_COST < pairs * _PAIR_COST:
                        found = index.candidates(tile.matrix(begin_b, end_b))
                if found is None or sum(int(many.sum(dtype=np.int64)) for *_, many in found) * _CANDIDATE_COST > pairs * _PAIR_COST:
                    all_pairs(first, second, edits, more, same)
                    continue
                for a, b in index.near(found, tile.letters[begin_b:end_b], tile.running(begin_b, end_b)):
                    offer(a + np.int64(begin_a), b + np.int64(begin_b), edits, more, same)
    settle()
    members = np.flatnonzero(root != np.arange(len(root)))
    return members, root[members]


_MEMBERS = pa.schema([("sid", pa.int64()), ("sequence", pa.string())])


def _sealed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes()


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def sequence_blocks(distinct: DataFrame) -> DataFrame:
    """(block, low, high, members): (sid, sequence) in order of length, packed; low and high are the lengths of a block."""
    rows = max(distinct.count(), 1)
    size = int(min(max(BLOCK_ROOT * rows ** 0.5, BLOCK_LEAST), BLOCK_MOST))
    l = F.length("sequence").cast("long").alias("l")
    ordered = distinct.select("sid", "sequence", l).repartitionByRange(min(max(-(-rows // size), 1), 10_000), "l", "sequence").sortWithinPartitions("l", "sequence")

    def lay(batches):
        number = TaskContext.get().partitionId() << 32
        held = None

        def block(part):
            nonlocal number
            number += 1
            lengths = part.column("l").to_numpy()
            return pa.RecordBatch.from_pydict({"block": [number], "low": [lengths[0]], "high": [lengths[-1]], "members": [_sealed(part.select(["sid", "sequence"]).cast(_MEMBERS))]})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            while held.num_rows:
                letters = np.cumsum(held.column("l").to_numpy())
                upto = max(1, min(size, int(np.searchsorted(letters, BLOCK_LETTERS, side="right"))))
                if upto >= held.num_rows and held.num_rows < size and letters[-1] < BLOCK_LETTERS:
                    break
                yield block(held.slice(0, upto))
                held = held.slice(upto)
        if held is not None and held.num_rows:
            yield block(held)

    return materialise(ordered.mapInArrow(lay, "block long, low long, high long, members binary"))


def block_links(blocks: DataFrame, identity: float) -> DataFrame:
    """(a, b) of sids: links that join the components of each tile, two blocks whose lengths allow the identity.

    A task takes the tiles of two runs of neighbouring blocks, so a block moves once for several tiles; two blocks are unpacked at a time.
    """
    side = lambda n: blocks.select(F.col("block").alias(f"b{n}"), F.col("low").alias(f"low{n}"), F.col("high").alias(f"high{n}"))
    per_edit = round(1.0 - identity, 9)
    reach = lambda n: F.col(f"high{n}") + F.floor(F.col(f"high{n}") * per_edit + 1e-9)
    # blocks are few: the table of tiles has one row per two of them, each side of it three numbers per block
    near = (F.col("b1") <= F.col("b2")) & (F.col("low2") <= reach(1)) & (F.col("low1") <= reach(2))
    tiles = materialise(side(1).join(F.broadcast(side(2)), near).select("b1", "b2").coalesce(shuffle_width(blocks)))
    run = max(1, round((tiles.count() / (_TASKS * shuffle_width(blocks))) ** 0.5))
    run_of = lambda block: F.floor(F.shiftright(block, 32) / run)
    tasks = tiles.select(run_of("b1").alias("t1"), run_of("b2").alias("t2"), F.explode(F.array("b1", "b2")).alias("block")).distinct()
    dealt = blocks.join(F.broadcast(tasks), "block").select("t1", "t2", "block", "low", "high", "members")

    def meet(table: pa.Table) -> pa.Table:
        t1, t2 = table.column("t1")[0].as_py(), table.column("t2")[0].as_py()
        block, low, high = (table.column(n).to_pylist() for n in ("block", "low", "high"))
        far = [x + int(np.floor(x * per_edit + 1e-9)) for x in high]
        order = sorted(range(len(block)), key=block.__getitem__)
        found = [(np.zeros(0, dtype=np.int64),) * 2]
        for i in (i for i in order if (block[i] >> 32) // run == t1):
            one = _opened(table.column("members")[i].as_py())
            for j in (j for j in order if (block[j] >> 32) // run == t2):
                if block[j] < block[i] or low[j] > far[i] or low[i] > far[j]:
                    continue
                two = None if i == j else _opened(table.column("members")[j].as_py())
                member, first = linked_members(one.column("sequence").to_pylist(), None if two is None else two.column("sequence").to_pylist(), identity)
                sids = np.concatenate([p.column("sid").to_numpy() for p in (one, two) if p is not None])
                found.append((sids[member], sids[first]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    width = min(max(tasks.select("t1", "t2").distinct().count(), 1), 20 * shuffle_width(blocks))
    return materialise(dealt.repartition(width, "t1", "t2").groupBy("t1", "t2").applyInArrow(meet, "a long, b long"))


def similarity_clusters(sequences: DataFrame, identity: float = 0.8) -> DataFrame:
    """Connected components of 'identity of the shorter at least ``identity``' over distinct sequences; named by their smallest one.

    Sequences are laid in blocks by length, and blocks whose lengths allow the identity meet tile by tile. Only blocks and, per tile, at
    most one link for each member move; the comparisons are all pairs of allowed lengths.
    """
    distinct = materialise(sequences.select("sequence").where("sequence is not null").distinct().select("sequence", F.monotonically_increasing_id().alias("sid")))
    links = block_links(sequence_blocks(distinct), identity)
    ends = links.select(F.explode(F.array("a", "b")).alias("sequence")).distinct()
    components = connected_components(ends, links).select(F.col("sequence").alias("sid"), F.col("cluster_id").alias("cid"))
    placed = materialise(distinct.join(components, "sid", "left").select("sequence", "cid"))
    names = placed.where("cid is not null").groupBy("cid").agg(F.min("sequence").alias("cluster_id"))
    return placed.join(names, "cid", "left").select("sequence", F.coalesce("cluster_id", "sequence").alias("cluster_id"))


# --- novelty -----------------------------------------------------------------------------------------

#: known sequences of a block, queries of a bucket, and pairs whose bounds are taken at once
KNOWN_BLOCK, QUERY_BUCKET, _BOUNDED_AT_ONCE = 2048, 8192, 1 << 21


def _letter_bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, letters, bigrams): counts per text; letters fall into 32 classes, so shared counts are never too small."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    codes = (np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32) & 31).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    letters = np.bincount(owner * 32 + codes, minlength=len(texts) * 32).reshape(-1, 32)
    inside = owner[1:] == owner[:-1]
    grams = np.bincount(owner[1:][inside] * 1024 + codes[:-1][inside] * 32 + codes[1:][inside], minlength=len(texts) * 1024)
    small = np.uint8 if lengths.max(initial=0) < 256 else np.int64
    return lengths, letters.astype(small), grams.reshape(-1, 1024).astype(np.float32)


def _common_letters(queries: list[str], known: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each pair, where the query fits one word of bits; matching blocks are a common subsequence."""
    common = np.full(len(left), np.iinfo(np.int64).max)
    size = np.array([len(x) for x in queries], dtype=np.int64)
    short = np.flatnonzero(size[left] < 64)
    if not len(short):
        return common
    code = lambda x: np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) & 31
    spots = np.zeros((len(queries), 32), dtype=np.uint64)
    for i in np.unique(left[short]):
        np.bitwise_or.at(spots[i], code(queries[i]), np.uint64(1) << np.arange(size[i], dtype=np.uint64))
    letters = [code(x) for x in known]
    q, k = left[short], right[short]
    order = np.argsort(k, kind="stable")
    q, k = q[order], k[order]
    ends = np.searchsorted(k, np.arange(len(known) + 1))
    row = np.full(len(q), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j, text in enumerate(letters):
        part = slice(ends[j], ends[j + 1])
        mine, state = spots[q[part]], row[part]
        if len(state):
            for c in text:
                hit = state & mine[:, c]
                state = (state + hit) | (state - hit)
            row[part] = state
    inside = (np.uint64(1) << size[q].astype(np.uint64)) - np.uint64(1)
    common[short[order]] = np.bitwise_count(~row & inside)
    return common


def possible_matches(queries: list[str], known: list[str], threshold: float):
    """Yields (query, known) positions, in order of queries, that hold every pair whose block-matching ratio reaches the threshold.

    With m matched letters of total length t the ratio is 2m / t. No more letters match than both texts share. The u = t - 2m
    others part at most u + 1 blocks, so at least m - u - 1 = 3m - t - 1 bigrams are shared; products of counts bound these.
    """
    k_size, k_letters, k_grams = _letter_bags(known)
    step = max(1, _BOUNDED_AT_ONCE // max(len(known), 1))
    for at in range(0, len(queries), step):
        q_size, q_letters, q_grams = _letter_bags(queries[at:at + step])
        total = q_size[:, None] + k_size[None, :]
        least = np.ceil(threshold * total / 2 - 1e-9)
        shared = np.zeros(total.shape, dtype=np.result_type(q_letters, k_letters))
        for letter in range(32):
            if k_letters[:, letter].any():
                shared += np.minimum(q_letters[:, letter, None], k_letters[None, :, letter])
        near = (shared >= least) & (q_grams @ k_grams.T >= 3 * least - total - 1)
        left, right = np.nonzero(near)
        kept = _common_letters(queries[at:at + step], known, left, right) >= least[left, right]
        yield left[kept] + at, right[kept]


def _best_matches(threshold: float, stop: float):
    """Of one tile: for each query the first known one at or above ``stop`` and the most similar one."""
    def match(queries: pa.Table, known: pa.Table) -> pa.Table:
        from difflib import SequenceMatcher

        names = queries.column("sequence").to_pylist()
        known = known.sort_by("idx")
        idx, texts = known.column("idx").to_pylist(), known.column("known").to_pylist()
        out = []
        if names and texts:
            found: dict[int, tuple] = {}
            done = set()
            for left, right in possible_matches(names, texts, threshold):
                for i, j in zip(left.tolist(), right.tolist()):
                    if i in done:
                        continue
                    sim = SequenceMatcher(None, names[i], texts[j]).ratio()
                    if sim >= threshold and (i not in found or sim > found[i][0] or sim >= stop):
                        found[i] = (sim, j)
                    if sim >= stop:
                        done.add(i)
            out = [(names[i], idx[j], texts[j], sim) for i, (sim, j) in found.items()]
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), known.schema.field("idx").type, pa.string(), pa.float64()))],
                        names=["sequence", "idx", "known", "sim"])

    return match


def novelty(queries: DataFrame, known: DataFrame, threshold: float = 0.8, stop: float = 0.95) -> DataFrame:
    """Is a sequence unlike every known one? ``known`` holds (idx, known).

    Known sequences are laid in blocks by length, queries dealt into buckets; a query meets the blocks whose lengths allow
    the threshold, tile by tile, and only (query, block) rows move. Letters and bigrams bound the ratio of all pairs of a
    tile; survivors reach the ratio itself. The best match is the first known one at or above ``stop``, else the most
    similar, earliest on ties. Novel rows carry no match.
    """
    distinct = materialise(queries.select("sequence").distinct())
    numbered = global_position(known.select("idx", "known").where("known is not null"), [F.length("known").asc(), F.col("known").asc(), F.col("idx").asc()], "_at")
    laid = materialise(numbered.withColumn("block", F.floor((F.col("_at") - 1) / KNOWN_BLOCK).cast("int")).drop("_at"))
    blocks = laid.groupBy("block").agg(F.min(F.length("known")).alias("_low"), F.max(F.length("known")).alias("_high"))
    buckets = max(1, -(-distinct.count() // QUERY_BUCKET))
    size, spread = F.length("sequence"), (2 - threshold) / max(threshold, 1e-9)
    # one row per KNOWN_BLOCK known sequences on the right
    tiles = distinct.where("sequence is not null").join(F.broadcast(blocks), (F.col("_high") * spread + 1e-6 >= size) & (F.col("_low") <= size * spread + 1e-6))
    tiles = tiles.select("sequence", F.col("block").alias("block"), F.pmod(F.xxhash64("sequence"), F.lit(buckets)).cast("int").alias("bucket"))
    sides = laid.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    width, kind = shuffle_width(queries), known.schema["idx"].dataType.simpleString()
    group = lambda df: df.repartition(width, "block", "bucket").groupBy("block", "bucket")
    scored = group(tiles).cogroup(group(sides)).applyInArrow(_best_matches(threshold, stop), f"sequence string, idx {kind}, known string, sim double")
    early = F.when(F.col("sim") >= stop, F.struct("idx", "sim", "known"))
    best = scored.groupBy("sequence").agg(
        F.min(early).alias("_stop"), F.max_by(F.struct("idx", "sim", "known"), F.struct("sim", -F.col("idx"))).alias("_top"))
    chosen = best.select("sequence", F.coalesce("_stop", "_top").alias("m"))
    return distinct.join(chosen, "sequence", "left").select(
        "sequence", F.col("m").isNull().alias("is_novel"), F.col("m.sim").alias("max_similarity"), F.col("m.known").alias("best_match"))


def novelty_levenshtein(queries: DataFrame, known: DataFrame, identity: float = 0.8) -> DataFrame:
    """Known partners within the edit threshold, through the same lossless segment index."""
    q = queries.select("sequence").distinct()
    k = known.select(F.col("known").alias("sequence")).distinct()
    longer_q = segment_probes(q, identity).withColumnRenamed("sequence", "a").join(segment_index(k, identity).withColumnRenamed("sequence", "b"), "token")
    longer_k = segment_probes(k, identity).withColumnRenamed("sequence", "b").join(segment_index(q, identity).withColumnRenamed("sequence", "a"), "token")
    hits = verified(longer_q.unionByName(longer_k), identity)
    return hits.withColumn("distance", F.levenshtein("a", "b"))
