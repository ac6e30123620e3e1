"""Pair and triad profiles whose cost is linear in the record length, counted in Arrow batches.

A record never has to fit the length rule here: pairs at all distances come from running letter counters (one pass
with 20 counters), triads from one class code per place. Each batch sends only sums per group, so little is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import RESIDUES

_PART = pa.schema([("grp", pa.string()), ("feature", pa.string()), ("n", pa.int64()), ("total", pa.float64())])
#: letters counted at once; a longer record is taken alone
_LETTERS_AT_ONCE = 1 << 18


#: partial sums that a task holds before it adds them up
_ROWS_HELD = 1 << 18


def added_up(parts, keys: Sequence[str]):
    """Batches of partial sums of one task, added up by ``keys`` while few rows are held: less is sent."""
    held, rows = [], 0

    def total():
        table = pa.Table.from_batches(held)
        values = [n for n in table.column_names if n not in keys]
        sums = table.group_by(list(keys), use_threads=False).aggregate([(v, "sum") for v in values])
        return sums.select([*keys, *[f"{v}_sum" for v in values]]).rename_columns(table.column_names)

    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows > _ROWS_HELD:
            sums = total()
            held, rows = (sums.to_batches(), sums.num_rows) if 2 * sums.num_rows <= _ROWS_HELD else ([], 0)
            if not held:
                yield from sums.to_batches()
    if held:
        yield from total().to_batches()


def _coded_records(batches, table: np.ndarray):
    """(groups, codes, record of each code, records) of consecutive rows; letters without a code are left out."""
    for batch in batches:
        column = batch.column("seq").cast(pa.large_string()).fill_null("")
        groups = batch.column("grp").to_pylist()
        if not len(column):
            continue
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset:]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(groups):
            upto = min(max(int(np.searchsorted(offsets, offsets[at] + _LETTERS_AT_ONCE, side="right")) - 1, at + 1), len(groups))
            codes = table[data[offsets[at]:offsets[upto]]]
            record = np.repeat(np.arange(upto - at), np.diff(offsets[at:upto + 1]))
            yield groups[at:upto], codes[codes >= 0], record[codes >= 0], upto - at
            at = upto


def _sums(groups: list, record: np.ndarray, item: np.ndarray, n: np.ndarray, share: np.ndarray, names: Sequence[str]):
    """Sums per (group, item) of a block, and under the empty item the records of each group."""
    known = sorted(set(groups), key=lambda g: (g is not None, g))
    place = {g: i for i, g in enumerate(known)}
    code = np.array([place[g] for g in groups], dtype=np.int64)
    key = code[record] * len(names) + item
    size = len(known) * len(names)
    counts, totals = np.bincount(key, weights=n, minlength=size), np.bincount(key, weights=share, minlength=size)
    used = np.flatnonzero(counts)
    rows = np.bincount(code, minlength=len(known))
    grp = [known[i] for i in used // len(names)] + known
    feature = [names[i] for i in used % len(names)] + [""] * len(known)
    return pa.RecordBatch.from_arrays([pa.array(grp, pa.string()), pa.array(feature, pa.string()), pa.array(np.concatenate([counts[used], rows]).astype(np.int64)),
                                       pa.array(np.concatenate([totals[used], np.zeros(len(known))]))], schema=_PART)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
    return keys[first], np.diff(np.append(first, len(keys)))


def _profile(df: DataFrame, by: str, seq: str, scan) -> DataFrame:
    """(by, feature, n_occurrences, mean) over all records of each group, those without the feature included."""
    parts = df.select(F.col(by).alias("grp"), F.col(seq).alias("seq")).mapInArrow(lambda batches: added_up(scan(batches), ["grp", "feature"]), "grp string, feature string, n long, total double")
    sums = parts.groupBy("grp", "feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = sums.where("feature = ''").select(F.col("grp").alias("_grp"), F.col("n").alias("_rows"))
    joined = sums.where("feature <> ''").join(rows, F.col("grp").eqNullSafe(F.col("_grp")))
    return joined.select(F.col("grp").alias(by), "feature", F.col("n").alias("n_occurrences"), (F.col("total") / F.col("_rows")).alias("mean"))


def skip_pair_profile(df: DataFrame, by: str, seq: str) -> DataFrame:
    """Mean relative frequency of each ordered letter pair at any distance: (by, feature, n_occurrences, mean_frequency)."""
    table = np.full(256, -1, dtype=np.int64)
    table[[ord(r) for r in RESIDUES]] = range(len(RESIDUES))
    width = len(RESIDUES)
    names = [a + b for a in RESIDUES for b in RESIDUES]

    def scan(batches):
        for groups, codes, record, records in _coded_records(batches, table):
            lengths = np.bincount(record, minlength=records)
            first = np.concatenate([[0], np.cumsum(lengths)])
            pairs = np.zeros((records * width, width))
            slot = record * width + codes  # (record, second letter)
            for letter in range(width):
                seen = np.concatenate([[0], np.cumsum(codes == letter)])
                before = seen[:-1] - seen[first[record]]  # how often ``letter`` stands before each place
                pairs[:, letter] = np.bincount(slot, weights=before, minlength=records * width)
            spot, letter = np.nonzero(pairs)
            n = pairs[spot, letter]
            owner = spot // width
            size = lengths * (lengths - 1) / 2
            yield _sums(groups, owner, letter * width + spot % width, n, n / size[owner], names)

    return _profile(df, by, seq, scan).withColumnRenamed("mean", "mean_frequency")


def class_triad_profile(df: DataFrame, by: str, seq: str, gaps: Sequence[int], classes: Mapping[str, str]) -> DataFrame:
    """Mean of (count - least count) / highest count of each class triad and gap: (by, feature, mean_share).

    The least count is 0 unless a record holds every triad. ``classes`` maps each class sign to its letters.
    """
    signs = list(classes)
    table = np.full(256, -1, dtype=np.int64)
    for i, sign in enumerate(signs):
        table[[ord(r) for r in classes[sign]]] = i
    k = len(signs)
    triads = [a + b + c for a in signs for b in signs for c in signs]
    names = [f"{t}.gap{g}" for g in gaps for t in triads]

    def scan(batches):
        for groups, codes, record, records in _coded_records(batches, table):
            owners, items, counts, shares = [], [], [], []
            for at, gap in enumerate(gaps):
                reach = 2 * (gap + 1)
                inside = np.flatnonzero(record[reach:] == record[:-reach]) if len(record) > reach else np.zeros(0, dtype=np.int64)
                triad = (codes[inside] * k + codes[inside + gap + 1]) * k + codes[inside + reach]
                key, n = _counted(record[inside] * k ** 3 + triad)
                owner = key // k ** 3
                kinds = np.bincount(owner, minlength=records)
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner  # keys are in order
                top, least = np.zeros(records), np.full(records, np.inf)
                if len(owner):
                    top[owner[first]], least[owner[first]] = np.maximum.reduceat(n, first), np.minimum.reduceat(n, first)
                low = np.where(kinds == k ** 3, least, 0.0)
                owners.append(owner)
                items.append(key % k ** 3 + at * k ** 3)
                counts.append(n)
                shares.append((n - low[owner]) / top[owner])
            yield _sums(groups, *(np.concatenate(x) for x in (owners, items, counts, shares)), names)

    return _profile(df, by, seq, scan).select(by, "feature", F.col("mean").alias("mean_share"))
