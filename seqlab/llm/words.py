"""Words of Arrow text columns as numpy arrays: bounds, 64-bit hashes and rolling n-gram hashes.

A column's UTF-8 bytes are cut into blocks of whole rows, so memory depends on the block size and the
longest single text, not on the batch. Every word byte is looked up in a table of 256 flags; both word
definitions in use separate at ASCII characters only, so bytes of longer characters need no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
#: for passes that give rows as they come, so that only memory hangs on the block
SMALL_BLOCK_BYTES = 1 << 19
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64, kept per process and grown when a longer block comes."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, min(1 << n.bit_length(), BLOCK_BYTES + 1), SMALL_BLOCK_BYTES + 1)
        steps = np.full((2, size), [[_BASE], [_INVERSE]], dtype=np.uint64)
        steps[:, 0] = 1
        _powers[:] = list(np.cumprod(steps, axis=1, dtype=np.uint64))
    return _powers


class Words:
    """Words of a block of texts. ``first[i]:first[i + 1]`` are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = letters[self.data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(inside):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = offsets[(offsets > 0) & (offsets < len(inside))]
            before[0] = after[-1] = False
            before[edges] = False
            after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hashes = self._total = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, from a prefix sum of byte values times powers of an odd base."""
        if self._hashes is None:
            up, down = _power_tables(len(self.data))
            total = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[self.data] * up[:len(self.data)], out=total[1:], dtype=np.uint64)
            self._total = total
            self._hashes = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        return self._hashes

    def prefixes(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word; shorter words give noise that depends on the next words."""
        up, down = _power_tables(len(self.data))
        if self._total is None:
            self.hashes()
        stop = np.minimum(self.start + size, len(self.data))
        return mix((self._total[stop] - self._total[self.start]) * down[self.start] + U64(0xABCDEF) * U64(size))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position; positions whose n words leave their text are noise."""
        return gram_hashes(self.hashes(), n)

    def left_in_text(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def strings(self, begin: int, stop: int) -> list[str]:
        raw = self.data
        return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(self.start[begin:stop], self.end[begin:stop])]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(max(len(hashes) - n + 1, 0), dtype=np.uint64)
    for i in range(n):
        total = total * U64(_BASE) + hashes[i:i + len(total)]
    out = np.zeros(len(hashes), dtype=np.uint64)
    out[:len(total)] = mix(total + U64(n))
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset:]
    data = np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1])) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, text bytes, offsets) of consecutive rows with at most ``size`` bytes of text, or one row."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at), data[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at]
            at = upto


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)
