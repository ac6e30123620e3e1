"""Main text of web pages: what a host repeats is found with suffix arrays over its pages' token streams.

1. Pages become blocks of text with a role from the markup (``page_blocks``): boilerplate, article, undecided.
2. The words of all blocks, inside and outside articles, are laid end to end by host in chunks of at most ``CHUNK_WORDS``
   words of a packet of pages. Each chunk gets a suffix array by prefix doubling; neighbours with a common prefix of
   ``min_words`` or more are one repeated substring. Chunks meet by the leading ``min_words`` words of their suffixes, so
   repeats across chunks of a host are found as well. The cut points only decide what is sorted together: a packet sends
   each prefix once, first a few bits of it, to learn which may stand in another packet as well, then the whole key
   of those (and of its own repeats) with flags that tell where it stands and whether on two pages.
3. Words covered by a substring that occurs on two or more pages of the host are repeated. What that means for a block
   is checked with the markup: an undecided block goes if half of it is repeated outside articles. A block of an article goes
   if no text element (``TEXT``) holds it and half of it is the host's template: repeated in articles and, on some page
   of the host, in what the markup calls boilerplate. Where a page has an article or main element, what lies outside goes.

Repetition alone can't give right results: copies of an article and passages that many articles share are
repeated across pages as well, but belong to the text, while menus and adverts of a host with one page never
repeat. So paragraphs, headings, items, cells and quotes of an article stay, repeated or not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.blobs import runs
from seqlab.llm.page_blocks import ARTICLE, BOILERPLATE, UNDECIDED, placed_blocks
from seqlab.llm.staging import bucketed
from seqlab.llm.words import NOT_SPACE, U64, Words, gram_hashes, mix, text_buffers

MIN_WORDS = 6
CHUNK_WORDS = 1 << 20
#: on a page whose undecided text is all covered, a copy, blocks of this many words stay
PROSE_WORDS = 25

#: pages of a packet, which moves as one row: at most so many, and no more once so many bytes are held
PACKET_BITS, PACKET_BYTES = 10, 4 << 20

#: at first a prefix moves with so many bits more than it takes to number all words; a packet sends to at most so many buckets
SPARE_BITS, MAX_BUCKETS = 5, 1 << 12
#: where a prefix stands in a packet: on a page, on two, on a page (two) outside articles, on a page (two) in articles, in boilerplate
ANY, ANY2, OUT, OUT2, IN, IN2, CHROME = (1 << i for i in range(7))

_BLOCK = pa.struct([("text", pa.string()), ("role", pa.int8()), ("first", pa.int32()), ("words", pa.int32())])
_SALT = U64(0x9E3779B97F4A7C15)


def _numbered(found: list[tuple[str, int, bool]]) -> list[dict]:
    """Blocks with their number of words and, outside articles, the number of the first one."""
    out, at = [], 0
    for text, role, told in found:
        text = text.encode("utf-8", "replace").decode()
        n = text.count(" ") + 1
        out.append({"text": text, "role": role, "first": at if role != ARTICLE else None, "words": n, "told": told})
        at += n if role != ARTICLE else 0
    return out


def _sealed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _rows(batches):
    """Rows as dicts, one at a time: they are large."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _opened(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def page_packets(pages: DataFrame) -> DataFrame:
    """(packet, words, outside, pages): the parsed pages, written once.

    ``outside`` holds (uid, host, text, marks) with the words outside articles and the number of words of each block there,
    negative in boilerplate; ``pages`` (uid, page_id, url, n_blocks, text, open, blocks) with the article's text and the numbers
    of its blocks that no text element holds or, without an article, the blocks. ``uid`` numbers the rows, ``words`` is the
    number of words. Text stays where it is when answers are joined to it.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    narrow = pages.select("page_id", "url", host.alias("host"), "html")

    def parse(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PACKET_BYTES, side="right"))
                part = batch.slice(at, min(max(upto - at, 1), 1 << PACKET_BITS))
                blocks = [_numbered(placed_blocks(h or "")) for h in part.column("html").to_pylist()]
                inside = [[b for b in page if b["role"] == ARTICLE] for page in blocks]
                outside = [[b for b in page if b["role"] != ARTICLE] for page in blocks]
                uids = pa.array((number << PACKET_BITS) + np.arange(part.num_rows))
                texts = pa.array(["\n\n".join(b["text"] for b in t) if t else None for t in inside], pa.string())
                untold = pa.array([[i for i, b in enumerate(t) if not b["told"]] for t in inside], pa.list_(pa.int32()))
                silent = pa.array([None if t else page for t, page in zip(inside, blocks)], pa.list_(_BLOCK))
                page_rows = pa.RecordBatch.from_arrays(
                    [uids, part.column("page_id"), part.column("url"), pa.array([len(b) for b in blocks]), texts, untold, silent],
                    names=["uid", "page_id", "url", "n_blocks", "text", "open", "blocks"])
                joined = pa.array([" ".join(b["text"] for b in t) for t in outside], pa.string())
                marks = pa.array([[-b["words"] if b["role"] == BOILERPLATE else b["words"] for b in t] for t in outside], pa.list_(pa.int32()))
                outside_rows = pa.RecordBatch.from_arrays([uids, part.column("host"), joined, marks], names=["uid", "host", "text", "marks"])
                n_words = sum(b["words"] for page in blocks for b in page)
                yield pa.RecordBatch.from_pydict({"packet": [number], "words": [n_words], "outside": [_sealed(outside_rows)], "pages": [_sealed(page_rows)]})
                number, at = number + 1, at + part.num_rows

    return bucketed(narrow.mapInArrow(parse, "packet long, words long, outside binary, pages binary"), "packet")


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes of ``words`` in order and the length of each one's common prefix with the one before.

    Prefix doubling: ranks by 1, 2, 4, ... words until all differ; a rank is the number of smaller suffixes, so only
    those that share theirs are sorted again. The last word must occur once.
    """
    _, rank, counts = np.unique(words, return_inverse=True, return_counts=True)
    tied = np.flatnonzero(counts[rank] > 1)
    rank = (np.cumsum(counts) - counts)[rank]
    levels, step = [rank], 1
    while len(tied):
        # a suffix that shares its first ``step`` words with another one does not end with them
        later = rank[tied + step]
        by = np.lexsort((later, rank[tied]))
        tied, later, old = tied[by], later[by], rank[tied[by]]
        first = runs(old, later)
        sizes = np.diff(np.append(first, len(tied)))
        group = runs(old)
        inside = np.arange(len(tied)) - np.repeat(group, np.diff(np.append(group, len(tied))))
        rank = rank.copy()
        rank[tied] = np.repeat(old[first] + inside[first], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        levels.append(rank)
        step *= 2
    order = np.empty(len(rank), dtype=np.int64)
    order[rank] = np.arange(len(rank))
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(order), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < len(rank))
        equal = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        common[equal + 1] += 1 << level
        a[equal] += 1 << level
        b[equal] += 1 << level
    return order, common


def _prefix_keys(words: np.ndarray, hosts: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
    """Key of the ``size`` words from each place within its host; 0 where fewer are left on the page."""
    keys = mix(gram_hashes(words, size) ^ (hosts * _SALT))
    return np.where(left >= size, keys | U64(1), U64(0))


class Streams:
    """Token streams of a packet in order of host and page: of each page the words outside articles, then those of its article.

    ``uids``, ``hosts``, ``inside`` and ``counts`` are per stream, ``words``, ``chrome`` (of a boilerplate block) and ``keys`` (of the
    ``size`` words from there, 0 where fewer are left) per word.
    """

    def __init__(self, outside: bytes, pages: bytes, size: int):
        around, within = _opened(outside), _opened(pages)
        held = []
        for at in range(0, around.num_rows, 256):
            rows = around.slice(at, 256)
            names, ends = text_buffers(rows.column("host"))
            # the host's letters as one word each
            hosts = np.array([_letters(names[a:b]) for a, b in zip(ends[:-1], ends[1:])], dtype=np.uint64) * _SALT
            marks = rows.column("marks").flatten().to_numpy()
            for inside, column in enumerate((rows.column("text"), within.slice(at, 256).column("text"))):
                words = Words(*text_buffers(column), NOT_SPACE, lower=False)
                chrome = np.zeros(len(words.start), dtype=bool) if inside else np.repeat(marks < 0, np.abs(marks))
                held.append((rows.column("uid").to_numpy(), hosts, np.full(rows.num_rows, bool(inside)), words.counts.astype(np.int64), words.hashes(), chrome))
        uids, hosts, inside, counts, words, chrome = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((inside, uids, hosts))
        first = np.cumsum(counts) - counts
        self.uids, self.hosts, self.inside, self.counts, self.size = uids[order], hosts[order], inside[order], counts[order], size
        self.first = np.cumsum(self.counts) - self.counts
        place = np.repeat(first[order] - self.first, self.counts) + np.arange(len(words))
        self.words, self.chrome = words[place], chrome[place]
        self.stream = np.repeat(np.arange(len(self.counts)), self.counts)
        left = np.repeat(self.first + self.counts, self.counts) - np.arange(len(words))
        self.keys = _prefix_keys(self.words, self.hosts[self.stream], left, size)

    def chunks(self, chunk_words: int):
        """Bounds of runs of streams with at most ``chunk_words`` words, or one stream."""
        begin = 0
        while begin < len(self.counts):
            stop = max(int(np.searchsorted(self.first + self.counts, self.first[begin] + chunk_words, side="right")), begin + 1)
            yield begin, stop
            begin = stop

    def prefixes(self, begin: int, stop: int):
        """Distinct leading words of the suffixes of a chunk, by suffix array: (key, inside, first page, last page, in boilerplate)."""
        a, b = self.first[begin], self.first[stop - 1] + self.counts[stop - 1]
        if a == b:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), *np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=bool)
        words, keys, stream, counts = self.words[a:b], self.keys[a:b], self.stream[a:b], self.counts[begin:stop]
        # every stream ends in a word of its own; suffixes of different hosts may be neighbours, their keys differ
        laid = np.empty(len(words) + len(counts), dtype=np.int64)
        own = np.zeros(len(laid), dtype=bool)
        own[np.cumsum(counts + 1) - 1] = True
        _, names = np.unique(words, return_inverse=True)
        laid[~own], laid[own] = names, -1 - np.arange(len(counts))
        place = np.full(len(laid), -1, dtype=np.int64)
        place[~own] = np.arange(len(words))
        order, common = suffix_array(laid)
        spots = place[order]
        # a group: neighbours in suffix order with the same first words
        group = np.cumsum(common < self.size)
        use = (spots >= 0) & (keys[np.maximum(spots, 0)] != 0)
        spots, group = spots[use], group[use]
        hosts, inside, uids = (x[stream[spots]] for x in (self.hosts, self.inside, self.uids))
        by = np.lexsort((uids, inside, hosts, group))
        spots, group, hosts, inside, uids = spots[by], group[by], hosts[by], inside[by], uids[by]
        first = runs(group, hosts, inside)
        last = np.append(first[1:], len(spots)) - 1 if len(first) else first
        other = np.concatenate([[0], np.cumsum(~self.chrome)])
        chrome = other[a + spots + self.size] == other[a + spots]
        return keys[spots[first]], inside[first], uids[first], uids[last], np.logical_or.reduceat(chrome, first) if len(first) else chrome

    def facts(self, chunk_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(key, flags) of every prefix that occurs, in order of the key."""
        found = [self.prefixes(a, b) for a, b in self.chunks(chunk_words)]
        keys, inside, low, high, chrome = (np.concatenate(c) for c in zip(*found))
        by = np.argsort(keys, kind="stable")
        keys, inside, low, high, chrome = keys[by], inside[by], low[by], high[by], chrome[by]
        first = runs(keys)
        if not len(first):
            return keys, np.zeros(0, dtype=np.uint8)
        flags = np.full(len(first), ANY, dtype=np.uint8)
        lowest, highest = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        flags[lowest != highest] |= ANY2
        none = np.iinfo(np.int64)
        for side, one, two in ((~inside, OUT, OUT2), (inside, IN, IN2)):
            lowest, highest = np.minimum.reduceat(np.where(side, low, none.max), first), np.maximum.reduceat(np.where(side, high, none.min), first)
            flags[lowest <= highest] |= one
            flags[lowest < highest] |= two
        flags[np.logical_or.reduceat(chrome, first)] |= CHROME
        return keys[first], flags

    def covered(self, keys: np.ndarray, flags: np.ndarray, wanted: int) -> np.ndarray:
        """Which words lie in a prefix that has all flags of ``wanted``; ``flags`` has those of the sorted ``keys``, others have none."""
        keys = keys[flags & wanted == wanted]
        change = np.zeros(len(self.words) + 1, dtype=np.int64)
        if len(keys):
            hit = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, self.keys), len(keys) - 1)] == self.keys)
            change[hit] += 1
            change[hit + self.size] -= 1
        return np.cumsum(change)[:-1] > 0


def _letters(name: np.ndarray) -> int:
    import zlib

    raw = name.tobytes()
    return zlib.crc32(raw) << 32 | zlib.adler32(raw)


def _low_bits(n: int, bits: int) -> int:
    return max(bits - n.bit_length(), 0)


def _squeezed(keys: np.ndarray, bits: int) -> bytes:
    """Sorted keys below 2 ** ``bits`` by Elias and Fano: low bits as they are, high ones as marks on a line, about 2 bits a key."""
    low = _low_bits(len(keys), bits)
    marks = np.zeros(len(keys) + (int(keys[-1]) >> low) + 1, dtype=bool)
    marks[(keys >> U64(low)).astype(np.int64) + np.arange(len(keys))] = True
    # big-endian bytes, so that the last ``low`` bits are the low ones
    lows = np.unpackbits(keys.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - low:]
    return np.packbits(lows).tobytes() + np.packbits(marks).tobytes()


def _spread_out(blob: bytes, n: int, bits: int) -> np.ndarray:
    low = _low_bits(n, bits)
    data, cut = np.frombuffer(blob, dtype=np.uint8), (n * low + 7) // 8
    whole = np.zeros((n, 64), dtype=np.uint8)
    whole[:, 64 - low:] = np.unpackbits(data[:cut], count=n * low).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(data[cut:])) - np.arange(n)
    return np.packbits(whole, axis=1).view(">u8")[:, 0].astype(np.uint64) | high.astype(np.uint64) << U64(low)


def _flag_bytes(flags: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(flags), "zstd", asbytes=True)


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n, "zstd", asbytes=True), dtype=np.uint8)


_SENT = "bucket int, packet long, n long, keys binary, flags binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("packet", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("flags", pa.binary())])


def _sent(packet: int, keys: np.ndarray, flags: np.ndarray | None, bits: int, bucket_bits: int) -> pa.RecordBatch:
    """Sorted keys of ``bits`` bits, packed by their leading bits."""
    rest = bits - bucket_bits
    edges = np.searchsorted(keys >> U64(rest), np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
    held = [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
    return pa.RecordBatch.from_pydict({
        "bucket": [i for i, _, _ in held], "packet": [packet] * len(held), "n": [b - a for _, a, b in held],
        "keys": [_squeezed(keys[a:b] & U64((1 << rest) - 1), rest) for _, a, b in held],
        "flags": [None if flags is None else _flag_bytes(flags[a:b]) for _, a, b in held]}, schema=_SENT_ARROW)


def _met(sent: pa.Table, bits: int):
    """Keys of one bucket from all packets: (bounds of the packets, keys, order of the keys, starts of equal ones in it)."""
    sizes = sent.column("n").to_pylist()
    keys = np.concatenate([_spread_out(k, n, bits) for k, n in zip(sent.column("keys").to_pylist(), sizes)])
    by = np.argsort(keys, kind="stable")
    return np.cumsum([0, *sizes]), keys, by, runs(keys[by])


def _back(first: np.ndarray, by: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of its group for every key, in the order in which they were sent."""
    out = np.empty(len(by), dtype=values.dtype)
    out[by] = np.repeat(values, np.diff(np.append(first, len(by))))
    return out


def _answers(met: DataFrame, name: str) -> DataFrame:
    return met.groupBy("packet").agg(F.collect_list(F.struct("bucket", "n", "keys", "flags")).alias(name))


def _in_order(answers: list[dict] | None) -> list[dict]:
    return sorted(answers or (), key=lambda a: a["bucket"])


def answered(packets: DataFrame, min_words: int, chunk_words: int) -> DataFrame:
    """(outside, pages, bucket_bits, answers): each packet with those of its prefixes that stand on two pages, and their flags.

    A packet sends a prefix once, so not even a host with a third of all pages makes a long group.
    """
    size = packets.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    bucket_bits = min(max(size[0] - 1, 7).bit_length(), MAX_BUCKETS.bit_length() - 1)
    bits = min(max(size[1].bit_length(), bucket_bits) + SPARE_BITS, 64)

    def ask(batches):
        for row in _rows(batches):
            keys = Streams(row["outside"], row["pages"], min_words).keys
            yield _sent(row["packet"], np.unique(keys[keys != 0] >> U64(64 - bits)), None, bits, bucket_bits)

    def twice(sent: pa.Table) -> pa.Table:
        bounds, _, by, first = _met(sent, bits - bucket_bits)
        several = _back(first, by, np.diff(np.append(first, len(by))) > 1)
        masks = [np.packbits(several[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return sent.set_column(sent.column_names.index("flags"), "flags", pa.array(masks, pa.binary())).set_column(
            sent.column_names.index("keys"), "keys", pa.nulls(len(masks), pa.binary()))

    def send(batches):
        for row in _rows(batches):
            keys, flags = Streams(row["outside"], row["pages"], min_words).facts(chunk_words)
            masks = [np.unpackbits(np.frombuffer(a["flags"], dtype=np.uint8), count=a["n"]) for a in _in_order(row["maybe"])]
            if masks:
                _, number = np.unique(keys >> U64(64 - bits), return_inverse=True)
                go = (np.concatenate(masks)[number] == 1) | (flags & ANY2 != 0)
                yield _sent(row["packet"], keys[go], flags[go], 64, bucket_bits)

    def meet(sent: pa.Table) -> pa.Table:
        bounds, keys, by, first = _met(sent, 64 - bucket_bits)
        flags = np.concatenate([_flags(f, n) for f, n in zip(sent.column("flags").to_pylist(), np.diff(bounds).tolist())])
        sorted_flags = flags[by]
        joined = np.bitwise_or.reduceat(sorted_flags, first)
        for one, two in ((ANY, ANY2), (OUT, OUT2), (IN, IN2)):
            # a page lies in one packet, so two packets are two pages
            joined[np.add.reduceat((sorted_flags & one != 0).astype(np.int64), first) > 1] |= two
        flags = _back(first, by, joined)
        held = [(i, a + np.flatnonzero(flags[a:b] & ANY2)) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
        held = [(i, at) for i, at in held if len(at)]
        sent = sent.take(pa.array([i for i, _ in held], pa.int64()))
        return pa.table([sent.column("bucket"), sent.column("packet"), pa.array([len(at) for _, at in held], pa.int64()),
                         pa.array([_squeezed(keys[at], 64 - bucket_bits) for _, at in held], pa.binary()),
                         pa.array([_flag_bytes(flags[at]) for _, at in held], pa.binary())], schema=_SENT_ARROW)

    asked = packets.mapInArrow(ask, _SENT).groupBy("bucket").applyInArrow(twice, _SENT)
    sent = packets.join(_answers(asked, "maybe"), "packet", "left").select("packet", "outside", "pages", "maybe").mapInArrow(send, _SENT)
    answers = _answers(sent.groupBy("bucket").applyInArrow(meet, _SENT), "answers")
    return packets.join(answers, "packet", "left").select("outside", "pages", F.lit(bucket_bits).alias("bucket_bits"), "answers")


def _known(row: dict, min_words: int) -> tuple[Streams, np.ndarray, np.ndarray]:
    """The streams of a packet, its prefixes that stand on two pages, and their flags."""
    rest, answers = 64 - row["bucket_bits"], _in_order(row["answers"])
    keys = [_spread_out(a["keys"], a["n"], rest) | U64(a["bucket"] << rest) for a in answers]
    flags = [_flags(a["flags"], a["n"]) for a in answers]
    return Streams(row["outside"], row["pages"], min_words), np.concatenate([np.zeros(0, dtype=np.uint64), *keys]), np.concatenate([np.zeros(0, dtype=np.uint8), *flags])


def repeated_words(packets: DataFrame, min_words: int = MIN_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(uid, covered): for pages with words, which of them a repeated substring covers; words outside articles come first."""
    def cover(batches):
        for row in _rows(batches):
            streams, *known = _known(row, min_words)
            covered = streams.covered(*known, ANY2)
            # the two streams of a page are neighbours
            sizes = streams.counts.reshape(-1, 2).sum(axis=1)
            some = sizes > 0
            bounds = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(streams.uids[::2][some]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(covered))], names=["uid", "covered"])

    return answered(packets, min_words, chunk_words).mapInArrow(cover, "uid long, covered array<boolean>")


def _chosen(blocks: list[dict], covered: np.ndarray) -> str:
    """Text of a page without articles; ``covered`` tells of each word outside articles whether the host repeats it there."""
    undecided = [(b, 2 * covered[b["first"]:b["first"] + b["words"]].sum() < b["words"]) for b in blocks if b["role"] == UNDECIDED]
    unique = any(u for _, u in undecided)
    return "\n\n".join(b["text"] for b, u in undecided if (u if unique else b["words"] >= PROSE_WORDS))


def _without_template(text: str, untold: list[int], template: np.ndarray) -> str:
    """Text of an article less the ``untold`` blocks that are half template; all of it if nothing else is left."""
    if not untold or not template.any():
        return text
    blocks = text.split("\n\n")
    ends = np.cumsum([b.count(" ") + 1 for b in blocks])
    begins = np.append(0, ends[:-1])
    gone = {i for i in untold if 2 * template[begins[i]:ends[i]].sum() >= ends[i] - begins[i]}
    return "\n\n".join(b for i, b in enumerate(blocks) if i not in gone) if len(gone) < len(blocks) else text


def main_text(pages: DataFrame, min_words: int = MIN_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars, n_blocks (of the page) and n_repeated (words, inside and outside articles, that the host repeats).

    Only page_id, url and html are read. A null html counts as an empty one and gives an empty text, a null url
    as a host of its own name (''), a null page_id stays. Repeated rows are pages of their own: they count as
    distinct pages of their host. Cut-off pages end all their elements.
    """
    packets = page_packets(pages)

    def finish(batches):
        for row in _rows(batches):
            streams, *known = _known(row, min_words)
            repeated, outside, template = (streams.covered(*known, wanted) for wanted in (ANY2, OUT2, IN2 | CHROME))
            rows, texts, n_repeated = _opened(row["pages"]), [], []
            at = {uid: i for i, uid in enumerate(streams.uids.tolist()) if not streams.inside[i]}
            for page in rows.select(["uid", "text", "open", "blocks"]).to_pylist():
                i = at[page["uid"]]
                begin, middle, end = streams.first[i], streams.first[i + 1], streams.first[i + 1] + streams.counts[i + 1]
                texts.append(_chosen(page["blocks"], outside[begin:middle]) if page["blocks"] is not None
                             else _without_template(page["text"], page["open"], template[middle:end]))
                n_repeated.append(int(repeated[begin:end].sum()))
            counts = [pa.array([len(t) for t in texts], pa.int64()), rows.column("n_blocks"), pa.array(n_repeated, pa.int64())]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), *counts],
                                             names=["page_id", "url", "text", "n_chars", "n_blocks", "n_repeated"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return answered(packets, min_words, chunk_words).mapInArrow(
        finish, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_repeated long")
