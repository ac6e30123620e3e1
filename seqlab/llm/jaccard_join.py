"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order of n-grams is that of their 64-bit hashes. It is cut into fragments at fixed points, and
a document's set falls into one piece per fragment. Two sets of at most h n-grams with Jaccard similarity t
differ in at most ``d = (1 - t) / (1 + t) * 2h`` n-grams, so of ``d + 1 + spare`` fragments at least ``1 + spare``
hold the same piece in both: documents that share a piece are the candidates, and no linked pair is missed. A
piece is several n-grams at once, so common passages alone seldom make candidates. A document leaves out its
pieces of fewer than three n-grams if it has at most ``spare`` of them, else those of fewer than two, else the
empty ones. Of two documents take the one with the lower limit: at most ``spare`` of its pieces lie below that, so one
of the pieces that both hold is kept by both.

A candidate pair is first compared by sketches, about a byte for eight n-grams: every n-gram flips one bit, so
sketches differ in at most as many bits as sets differ in n-grams, and pairs that differ in more bits than
the similarity allows are out. For the others, overlaps are counted fragment by fragment (coarser fragments of the same order) and
summed per pair, which gives the exact Jaccard similarity.

Copies never form pairs: equal sets are one class before anything is joined. To find the components, in every
candidate group the members first meet one member of it, chosen by hash; then those outside a large component of
their groups meet some of its members; then each meets its nearest by sketches. A family of n near copies costs
a few times n comparisons so far. Only members that are still in different components and whose sketches are close
are then compared without exception. The links themselves lie within
components. Once these stand, the classes of a component are dealt into tiles of bounded size and every two
tiles meet once, which counts all overlaps exactly.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlab.llm.blobs import pack, runs, small, unpack
from seqlab.llm.graph import components
from seqlab.llm.staging import hash_bitmap, in_bitmap, staged, width
from seqlab.llm.words import NOT_SPACE, SMALL_BLOCK_BYTES, U64, Words, blocks, mix, signed

BAND_GROWTH = 1.2
COUNTING_FRAGMENTS = 8
#: Bits of a sketch for each n-gram, at least: the more, the fewer n-grams hide each other and the fewer pairs are counted in vain.
SKETCH_BITS = 4
#: A component is large in a group if it holds one in so many of the members; and kinds of keys, each with a member of its own for the others to meet.
LARGE_PART, TRIES = 10, 16
#: Near copies share many groups: pairs are looked for in one of so many first, where a class is compared with so many others at
#: most, and in all groups once these are linked.
FIRST_KEYS, NEAREST = 16, 2
#: n-grams of a tile of a component, where a small set counts as LEAST_WEIGHT; and n-grams compared at a time.
TILE_GRAMS = 1 << 15
LEAST_WEIGHT = 512
COLUMNS = 4096


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one gram of all its words."""
    grams = words.grams(n)
    sets = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if end - begin >= n:
            sets.append(np.unique(grams[begin:end - n + 1]))
        elif end > begin:
            sets.append(_short(words.hashes()[begin:end]))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def _short(whole: np.ndarray) -> np.ndarray:
    value = np.full(1, len(whole), dtype=np.uint64)
    for h in whole:
        value = mix(value * U64(0xD6E8FEB86659FD93) + h)
    return value


def band_limits(band: int) -> tuple[int, int]:
    """Set sizes (low, high), both included, of a size band."""
    return int(np.ceil(BAND_GROWTH ** band)), int(np.ceil(BAND_GROWTH ** (band + 1))) - 1


def band_of(size: int) -> int:
    band = int(np.log(size) / np.log(BAND_GROWTH))
    while band_limits(band)[1] < size:
        band += 1
    while band_limits(band)[0] > size:
        band -= 1
    return band


def difference_bound(high: int, percent: int) -> int:
    """Most n-grams in which two sets of at most ``high`` can differ at a Jaccard similarity of ``percent`` / 100."""
    return 2 * high * (100 - percent) // (100 + percent)


def piece_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the pieces by which a set meets candidates: those of its band, and of the next if a partner can lie there."""
    size = len(grams)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    band, keys = band_of(size), []
    reach = size * 100 // percent
    while band_limits(band)[0] <= reach:
        if band_limits(band)[0] <= band_limits(band)[1]:  # narrow bands may hold no whole number
            keys.append(_band_keys(grams, band, percent))
        band += 1
    return np.concatenate(keys)


@lru_cache(maxsize=None)
def cut(band: int, percent: int) -> tuple[int, int]:
    """(d, spare): the most n-grams in which sets of a band differ, and the fragments cut so that few sets keep pieces of one n-gram."""
    low, high = band_limits(band)
    differ = difference_bound(high, percent)
    spare = 1 + differ // 16

    def poor(parts: int) -> float:
        """Pieces of fewer than two n-grams that hardly any set exceeds (mean and two deviations of a Poisson law)."""
        mean = low / parts
        share = math.exp(-mean) * (1 + mean)
        return parts * share + 2 * math.sqrt(parts * share * (1 - share))

    while spare < differ and poor(differ + 1 + spare) > spare:
        spare += 1
    return differ, spare


def _band_keys(grams: np.ndarray, band: int, percent: int) -> np.ndarray:
    differ, spare = cut(band, percent)
    if not differ:  # partners are equal sets, which are one class already
        return np.zeros(0, dtype=np.uint64)
    parts = differ + 1 + spare
    part = ((grams >> U64(32)) * U64(parts)) >> U64(32)
    bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    total = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(mix(grams ^ U64(0xA5A5A5A55A5A5A5A)), out=total[1:], dtype=np.uint64)
    content = total[bounds[1:]] - total[bounds[:-1]]
    keys = mix(mix(content + U64(band)) + np.arange(parts, dtype=np.uint64))
    sizes = np.diff(bounds)
    for least in (3, 2, 1):
        if int((sizes < least).sum()) <= spare:
            return keys[sizes >= least]
    return keys


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the n-grams that fall on each of 64 * 2^k bits, the least such number that is not below SKETCH_BITS times the set's size."""
    bits = 64
    while bits < SKETCH_BITS * len(grams):
        bits *= 2
    place = (mix(grams ^ U64(0x3C6EF372FE94F82B)) & U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _folded(name: str) -> Column:
    """The sketch of half as many bits, down to 64."""
    half = F.floor(F.size(name) / 2).cast("int")
    return F.when(F.size(name) > 1, F.zip_with(F.slice(name, F.lit(1), half), F.slice(name, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(name))


def _apart(one: str, two: str, percent: int) -> Column:
    """Bits in which the sketches of two sets differ; null if their sizes n alone are too far apart for the similarity."""
    def halved(own: str, other: str) -> Column:
        n = F.size(other)
        folded = F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, n + 1, n), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > n, folded).otherwise(F.col(own))

    a, b = f"sketch{one}", f"sketch{two}"
    near = F.least(f"n{one}", f"n{two}") * 100 >= F.greatest(f"n{one}", f"n{two}") * percent
    differ = F.zip_with(halved(a, b), halved(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    # sizes as near as this have sketches of one length, or of one and its double (percent is above 50)
    return F.when(near, F.aggregate(differ, F.lit(0), lambda x, y: x + y))


def _close(one: str, two: str, percent: int) -> Column:
    """May sets of sizes n, with these sketches, reach the similarity? Never false for sets that do."""
    sizes = F.col(f"n{one}") + F.col(f"n{two}")
    return F.coalesce(_apart(one, two, percent) * (100 + percent) <= sizes * (100 - percent), F.lit(False))


def _signatures(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, two 64-bit checksums of the set, a key of the text, the piece keys and the sketch of the set."""
    def run(batches):
        for rows, data, offsets in blocks(batches, size=SMALL_BLOCK_BYTES):
            sets = shingle_sets(Words(data, offsets, NOT_SPACE), n)
            keys = [piece_keys(s, percent) for s in sets]
            sketches = [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(s) for s in sets], pa.int64()), *_checksums(sets), rows.column(2), _lists([signed(k) for k in keys]), _lists(sketches)],
                names=["doc_id", "n_shingles", "sum1", "sum2", "text_key", "keys", "sketch"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, sum1 bigint, sum2 bigint, text_key bigint, keys array<bigint>, sketch array<bigint>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32), pa.array(np.concatenate(parts)))


def _checksums(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(signed(np.array([mix(s + U64(seed)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64))) for seed in (1, 2)]


def _pieces(documents: DataFrame, wanted: np.ndarray, n: int, fragments: int = COUNTING_FRAGMENTS) -> DataFrame:
    """Sets cut for counting, for rows whose text key tests true: one row per set and fragment that is not empty."""
    def asked(batches):
        for batch in batches:
            keep = in_bitmap(wanted, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            if keep.any():  # other texts are not hashed
                yield batch.filter(pa.array(keep))

    def run(batches):
        done: set[int] = set()  # a task sends a set once, however many copies it meets
        for _, data, offsets in blocks(asked(batches), size=SMALL_BLOCK_BYTES):
            sets = shingle_sets(Words(data, offsets, NOT_SPACE), n)
            out: list[tuple] = []
            sums = [a.to_pylist() for a in _checksums(sets)]
            for s, one, two in zip(sets, *sums):
                if one in done or not len(s):
                    continue
                done.add(one)
                edges = np.searchsorted(((s >> U64(32)) * U64(fragments)) >> U64(32), np.arange(fragments + 1, dtype=np.uint64))
                out += [(one, two, len(s), f, s[a:b].view(np.int64)) for f, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            names = ["sum1", "sum2", "n_shingles", "fragment", "grams"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = documents.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return rows.mapInArrow(run, "sum1 bigint, sum2 bigint, n_shingles bigint, fragment int, grams array<bigint>")


def _shared_keys(found: DataFrame) -> DataFrame:
    """(key, sum1) of the piece keys that different sets hold.

    A task sends each bucket its keys as packed arrays; equal sets of a task count once, so copies are
    merged before the shuffle. Most keys occur in one set and end in their bucket.
    """
    buckets = width(found)

    def send(batches):
        for batch in batches:
            sums, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
            batch = batch.take(pa.array(at))
            keys = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(len(sums)), np.diff(batch.column(1).offsets.to_numpy()))
            bucket = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
                if high > low:
                    mine = order[low:high]
                    used, place = np.unique(owner[mine], return_inverse=True)
                    blob = pack(keys[mine], sums[used], small(place))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

    def receive(table: pa.Table) -> pa.Table:
        parts = [unpack(blob) for blob in table.column("blob").to_pylist()]
        keys = np.concatenate([p[0] for p in parts])
        sums = np.concatenate([p[1][p[2].astype(np.int64)] for p in parts])
        order = np.lexsort((sums, keys))
        keys, sums = keys[order], sums[order]
        once = runs(keys, sums)
        keys, sums = keys[once], sums[once]
        group = runs(keys)
        size = np.diff(np.append(group, len(keys)))
        keep = np.repeat(size > 1, size)
        return pa.Table.from_arrays([pa.array(signed(keys[keep])), pa.array(signed(sums[keep]))], names=["key", "sum1"])

    packed = found.select("sum1", "keys").mapInArrow(send, "bucket int, blob binary")
    return packed.groupBy("bucket").applyInArrow(receive, "key bigint, sum1 bigint")


def linked(documents: DataFrame, members: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those that reach the similarity. Partial overlaps are counted per fragment and summed per pair."""
    pairs = staged(pairs)
    wanted = members.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").drop("sketch")
    wanted = staged(wanted)
    identity = ["sum1", "sum2", "n_shingles"]
    # one exchange serves both the removal of copies and the join
    cut = _pieces(documents, hash_bitmap(wanted, "text_key"), n).repartition(*identity).dropDuplicates([*identity, "fragment"])
    pieces = staged(cut.join(wanted.drop("text_key"), identity).select("id", "fragment", "grams", F.col("n_shingles").alias("n")))
    left, right = (pieces.select(F.col("id").alias(x), "fragment", F.col("grams").alias("g" + x), F.col("n").alias("n" + x)) for x in "ab")
    met = left.join(pairs, "a").join(right, ["b", "fragment"])
    counted = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("common"))
    return summed.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Number of n-grams that each set of ``one`` shares with each of ``two``, summed over runs of the order of n-grams."""
    def laid(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (grams, owner), (others, holder) = laid(one), laid(two)
    shared = np.intersect1d(grams, others)
    common = np.zeros((len(one), len(two)), dtype=np.int64)

    def placed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, values)
        held = shared[np.minimum(at, len(shared) - 1)] == values
        at, rows = at[held], rows[held]
        order = np.argsort(at, kind="stable")
        return at[order], rows[order]

    if not len(shared):
        return common
    sides = [(*placed(grams, owner), len(one)), (*placed(others, holder), len(two))]
    for begin in range(0, len(shared), COLUMNS):
        dense = []
        for at, rows, height in sides:
            low, high = np.searchsorted(at, [begin, begin + COLUMNS])
            block = np.zeros((height, min(COLUMNS, len(shared) - begin)), dtype=np.float32)
            block[rows[low:high], at[low:high] - begin] = 1
            dense.append(block)
        common += np.rint(dense[0] @ dense[1].T).astype(np.int64)  # at most COLUMNS, exact in a float
    return common


def _tile_links(documents: DataFrame, placed: DataFrame, n: int, percent: int, pairs: bool) -> DataFrame:
    """All links between classes of one component, for ``placed`` (id, c, sum1, sum2, n_shingles, text_key).

    Rows (a, b, common) of linked classes, or with ``pairs`` false (id, n_links), to be summed.
    """
    weight = F.sum(F.greatest("n_shingles", F.lit(LEAST_WEIGHT)))
    tiles = placed.groupBy("c").agg(F.ceil(weight / TILE_GRAMS).cast("int").alias("tiles"))
    identity = ["sum1", "sum2", "n_shingles"]
    wanted = staged(placed.join(tiles, "c").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")))
    cut = _pieces(documents, hash_bitmap(wanted, "text_key"), n, 1).repartition(*identity).dropDuplicates(identity)
    sets = staged(cut.join(wanted.drop("text_key"), identity).select("id", "c", "tile", "tiles", "grams"))
    # a tile meets each tile of its component once, itself included
    dealt = sets.select("id", "c", "tile", "grams", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("c", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "id", "grams")

    def meet(table: pa.Table) -> pa.Table:
        ids, tile = table.column("id").to_numpy(), table.column("tile").to_numpy()
        grams = [g.values.to_numpy(zero_copy_only=False).view(np.uint64) for g in table.column("grams")]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sides = [np.flatnonzero(tile == low), np.flatnonzero(tile == high)]
        if not (len(sides[0]) and len(sides[1])):
            return none
        one, two = ([grams[i] for i in side] for side in sides)
        common = overlaps(one, two)
        sizes = [np.array([len(g) for g in side]) for side in (one, two)]
        reached = common * 100 >= (sizes[0][:, None] + sizes[1][None, :] - common) * percent
        if low == high:
            reached &= np.triu(np.ones_like(reached), 1)
        x, y = np.nonzero(reached)
        a, b = ids[sides[0][x]], ids[sides[1][y]]
        if pairs:
            return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(common[x, y])], names=["a", "b", "common"])
        ends, count = np.unique(np.concatenate([a, b]), return_counts=True)
        return pa.table([pa.array(ends), pa.array(count)], names=["id", "n_links"])

    names = ["a", "b", "common"] if pairs else ["id", "n_links"]
    none = pa.table([pa.array([], pa.int64())] * len(names), names=names)
    return dealt.groupBy("c", "low", "high").applyInArrow(meet, ", ".join(f"{x} bigint" for x in names))


IDENTITY = ["sum1", "sum2", "n_shingles"]


def _joined(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their sets, and classes of equal sets with the smallest class ``c`` of their component."""
    found = staged(_signatures(documents, n, percent).withColumn("row", F.monotonically_increasing_id()))
    identity = IDENTITY
    classes = staged(found.where("n_shingles > 0").groupBy(*identity).agg(
        F.min("row").alias("id"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "text_key")).alias("first"), F.min("text_key").alias("text_key")))

    groups = staged(_shared_keys(found).join(classes.select("sum1", "id"), "sum1").select("key", "id").distinct())

    def meet_one(rows: DataFrame) -> DataFrame:
        """Each member of a group with the one member that a hash chooses, unless they are in one component."""
        one = rows.groupBy("key").agg(F.min_by(F.struct("id", "c"), F.xxhash64("key", "id")).alias("one"))
        return rows.join(one, "key").where(F.col("c") != F.col("one.c")).select("key", "id", F.col("one.id").alias("one"))

    def meet_most(rows: DataFrame) -> DataFrame:
        """Members outside a component that holds a large part of their group, each with some members inside.

        The members inside are chosen by hash, another one for each of a few kinds of keys.
        """
        parts = rows.groupBy("key", "c").agg(F.count("*").alias("size"), F.min_by("id", F.xxhash64("id", F.pmod("key", F.lit(TRIES)))).alias("id"))
        most = parts.groupBy("key").agg(F.max_by(F.struct("id", "c", "size"), F.struct("size", F.xxhash64("c"))).alias("one"), F.sum("size").alias("all"))
        most = most.where((F.col("one.size") > 1) & (F.col("one.size") * LARGE_PART >= F.col("all"))).select("key", "one")
        return rows.join(most, "key").where(F.col("c") != F.col("one.c")).select("id", F.col("one.id").alias("one")).distinct()

    members = groups.select("id").distinct().join(found.select(F.col("row").alias("id"), "sketch"), "id")
    members = staged(members.join(classes, "id").select("id", *identity, "text_key", "sketch"))

    def sketched(side: str) -> DataFrame:
        return members.select(F.col("id").alias(side), F.col("n_shingles").alias("n" + side), F.col("sketch").alias("sketch" + side))

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...) of classes whose sketches are close, with the number of bits in which they differ."""
        both = pairs.join(sketched("a"), "a").join(sketched("b"), "b").where(_close("a", "b", percent))
        return both.select(*pairs.columns, _apart("a", "b", percent).alias("apart"))

    def links_of(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes the links."""
        return staged(linked(documents, members, close(pairs.distinct()).select("a", "b"), n, percent))

    def settle(links: DataFrame, rows: DataFrame) -> DataFrame:
        """key, id, component of those groups of ``rows`` (key, id) that are not yet within one component."""
        placed = rows.join(components(links), F.col("id") == F.col("v"), "left").select("key", "id", F.coalesce("c", "id").alias("c"))
        placed = staged(placed)
        open_keys = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
        return staged(placed.join(open_keys, "key"))

    ordered = [F.least("id", "one").alias("a"), F.greatest("id", "one").alias("b")]
    # at first each class meets the chosen member of one of its groups only
    first = meet_one(groups.withColumn("c", F.col("id"))).groupBy("id").agg(F.min_by("one", F.xxhash64("key")).alias("one"))
    links = links_of(first.select(*ordered))
    # then each class outside a large component of its groups the nearest of some members inside
    nearest = close(meet_most(settle(links, groups)).select("id", *ordered)).groupBy("id").agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("pair"))
    links = staged(links.unionByName(links_of(nearest.select("pair.a", "pair.b"))).distinct())
    # what is left is often a family below the similarity: coarse sketches tell which members have a close one in another
    # component, and only these are compared with all members of their groups as they meet
    coarse = members.select("id", F.col("n_shingles").alias("n"), "sketch").withColumn("sketch", _folded("sketch")).withColumn("sketch", _folded("sketch"))
    rest = staged(settle(links, groups).join(coarse, "id"))

    def across(rows: DataFrame, how: str) -> DataFrame:
        one, two = (rows.select("key", *(F.col(c).alias(c + side) for c in ("id", "c", "n", "sketch"))) for side in "ab")
        ordered = F.col("ida") < F.col("idb") if how == "inner" else F.lit(True)
        return one.join(two.withColumnRenamed("key", "other"), (F.col("key") == F.col("other")) & (F.col("ca") != F.col("cb")) & ordered & _close("a", "b", percent), how)

    near = staged(across(rest, "left_semi").select("key", F.col("ida").alias("id"), F.col("ca").alias("c")))

    def met(rows: DataFrame) -> DataFrame:
        fine = rows.join(members.select("id", F.col("n_shingles").alias("n"), "sketch"), "id")
        return across(fine, "inner").select(F.col("ida").alias("a"), F.col("idb").alias("b"), _apart("a", "b", percent).alias("apart")).distinct()

    some = met(near.where(F.pmod("key", F.lit(FIRST_KEYS)) == 0))
    both = some.select("*", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("one")), F.struct(F.col("b").alias("id"), F.col("a").alias("one")))).alias("way"))
    some = both.groupBy("way.id", F.pmod(F.xxhash64("way.one"), F.lit(NEAREST))).agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("pair"))
    some = staged(some.select("pair.a", "pair.b").distinct())
    links = staged(links.unionByName(links_of(some)).distinct())
    # pairs compared already have no link if they are still in different components
    left = met(settle(links, near.select("key", "id"))).select("a", "b").join(some, ["a", "b"], "left_anti")
    links = staged(links.unionByName(links_of(left)).distinct())

    return found, staged(classes.join(components(links), F.col("id") == F.col("v"), "left").withColumn("c", F.coalesce("c", "id")).drop("v"))


def _members(joined: DataFrame) -> DataFrame:
    """Classes of the components that hold several."""
    several = joined.groupBy("c").count().where("count > 1").select("c")
    return joined.join(several, "c").select("id", "c", *IDENTITY, "text_key")


def jaccard_pairs(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per link between different sets: doc_a, text_key_a, n_a, doc_b, text_key_b, n_b, common.

    Complete: every two different sets that reach the similarity. A set is named by the first row that holds
    it (smallest id, then any); its copies share its links and are not repeated here.
    """
    _, joined = _joined(documents, n, percent)
    links = _tile_links(documents, _members(joined), n, percent, pairs=True)

    def side(x: str) -> DataFrame:
        return joined.select(F.col("id").alias(x), F.col("first.doc_id").alias(f"doc_{x}"), F.col("first.text_key").alias(f"text_key_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    return links.join(side("a"), "a").join(side("b"), "b").select(*(f"{x}_{y}" for y in "ab" for x in ("doc", "text_key", "n")), "common")


def jaccard_components(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, first_of_component, n_links.

    Links hold between different sets; n_links is the number of different sets that reach the similarity with
    the row's own (``jaccard_pairs`` lists them). Null or empty texts have an empty set, no links, and are their own
    component. Repeated rows each give a row; a null id is never the smallest of a component unless all
    its ids are null. ``first_of_component`` marks one row of each component (smallest id, then any). Other
    columns are ignored.
    """
    found, joined = _joined(documents, n, percent)
    identity = IDENTITY
    ends = _tile_links(documents, _members(joined), n, percent, pairs=False).groupBy("id").agg(F.sum("n_links").alias("n_links"))
    least = joined.groupBy("c").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    named = joined.select(*identity, "id", "c").join(least, "c").join(ends, "id", "left")
    named = named.select(*identity, "component_id", F.col("first.row").alias("first_row"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = found.select("row", "doc_id", "text_key", *identity).join(named, identity, "left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      (empty | (F.col("row") == F.col("first_row"))).alias("first_of_component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key")
