"""Descriptors per record and their profiles, computed in Arrow batches of many records at once.

A batch's letters are one array with the record of each letter, so every sum is one pass over the letters, whatever the
record length; nothing is evaluated letter by letter. Profiles send only sums per group and feature.
Null records and, where letters need values, records with letters outside the 20 residues get null descriptors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions import descriptors as D
from ..functions.scalars import RESIDUES
from .ordered_counts import added_up

#: letters taken at once; a longer record is taken alone
_LETTERS_AT_ONCE = 1 << 18


class Letters:
    """Consecutive records: ``code`` points of their letters, the ``record`` of each letter, ``size`` and ``null`` of each record."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        self.null = np.asarray(column.is_null())
        texts = column.fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset:]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        self.size = np.diff(offsets)
        self.code = raw
        if (raw >= 128).any():
            self.code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            self.size = np.array([len(x) for x in texts.to_pylist()], dtype=np.int64)
        self.n = len(texts)
        self.record = np.repeat(np.arange(self.n), self.size)
        self.place = np.arange(len(self.record)) - np.repeat(np.cumsum(self.size) - self.size, self.size)

    def residues(self) -> np.ndarray:
        """Position of each letter in RESIDUES, -1 for others."""
        table = np.full(128, -1, dtype=np.int64)
        table[[ord(r) for r in RESIDUES]] = range(len(RESIDUES))
        return np.where(self.code < 128, table[np.minimum(self.code, 127)], -1)

    def sums(self, values: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.record[at], weights=values, minlength=self.n)

    def within(self, reach: int) -> np.ndarray:
        """Places whose partner ``reach`` letters on lies in the same record."""
        if len(self.record) <= reach:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.record[reach:] == self.record[:-reach])

    def counts(self, residue: np.ndarray) -> np.ndarray:
        known = residue >= 0
        return np.bincount(self.record[known] * len(RESIDUES) + residue[known], minlength=self.n * len(RESIDUES)).reshape(self.n, -1)


def _blocks(batch: pa.RecordBatch, column: int):
    """(slice of the batch, its letters) in blocks of bounded size."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LETTERS_AT_ONCE, side="right")), at + 1)
        part = batch.slice(at, upto - at)
        yield part, Letters(part.column(column))
        at = upto


def _with_columns(df: DataFrame, seq: str, names: Sequence[str], compute) -> DataFrame:
    """``df`` with a double column per name; ``compute`` gives (values of each name, records without values)."""
    place = df.columns.index(seq)
    schema = StructType(list(df.schema.fields))
    for name in names:
        schema = schema.add(name, DoubleType())

    def scan(batches):
        for batch in batches:
            for part, letters in _blocks(batch, place):
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    values, undefined = compute(letters)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(np.asarray(v, dtype=np.float64), mask=undefined) for v in values]], names=[*part.schema.names, *names])

    return df.mapInArrow(scan, schema)


def _share(top, bottom):
    return np.where(bottom != 0, top / np.where(bottom != 0, bottom, 1), 0.0)


def _foreign(letters: Letters, residue: np.ndarray) -> np.ndarray:
    return letters.null | (np.bincount(letters.record, weights=residue < 0, minlength=letters.n) > 0)


def _scale(values: Mapping[str, float]) -> np.ndarray:
    return np.array([float(values[r]) for r in RESIDUES])


def with_phys8(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """Eight normalised descriptors; all zero for an empty sequence."""
    at = {r: i for i, r in enumerate(RESIDUES)}

    def charge(counts, ph):
        acid = np.power(10.0, ph)
        up = lambda pka: 1.0 / (1.0 + acid / 10.0 ** pka)
        down = lambda pka: 1.0 / (1.0 + 10.0 ** pka / acid)
        total = up(D.PKA_N_TERM) - down(D.PKA_C_TERM)
        for r, pka in D.PKA_POSITIVE.items():
            total = total + counts[:, at[r]] * up(pka)
        for r, pka in D.PKA_NEGATIVE.items():
            total = total - counts[:, at[r]] * down(pka)
        return total

    def compute(letters: Letters):
        residue = letters.residues()
        counts, size = letters.counts(residue), letters.size
        # records of equal counts of ionisable letters share their curve
        ionisable = [at[r] for r in (*D.PKA_POSITIVE, *D.PKA_NEGATIVE)]
        kinds, kind = np.unique(counts[:, ionisable], axis=0, return_inverse=True)
        table = np.zeros((len(kinds), len(RESIDUES)), dtype=np.int64)
        table[:, ionisable] = kinds
        low = np.zeros(len(kinds))
        for k in range(1, 61):
            width = 14.0 / 2 ** k
            low = low + np.where(charge(table, low + width) > 0, width, 0.0)
        net, low = charge(table, np.full(len(kinds), 7.4))[kind.ravel()], low[kind.ravel()]
        value = _scale(D.KD)[residue]
        angle = letters.place * np.radians(100.0)
        moment = np.sqrt(letters.sums(value * np.cos(angle)) ** 2 + letters.sums(value * np.sin(angle)) ** 2)
        aliphatic = counts[:, at["A"]] + 2.9 * counts[:, at["V"]] + 3.9 * (counts[:, at["I"]] + counts[:, at["L"]])
        # in the order of RESIDUES, as the columns and the SQL add up
        added = lambda scale: sum((counts[:, at[r]] * scale[r] for r in RESIDUES), np.zeros(letters.n))
        aromatic = counts[:, at["F"]] + counts[:, at["Y"]] + counts[:, at["W"]]
        raw = (size / 100.0, net / 10.0, added(D.KD) / size / 4.5, added(D.BOMAN) / size / 3.0, aliphatic / size * 100.0 / 150.0,
               low / 14.0, aromatic / size, moment / size / 2.0)
        return [np.where(size == 0, 0.0, v) for v in raw], _foreign(letters, residue)

    return _with_columns(df, seq, [f"phys8_{n}" for n in D.PHYS8], compute)


def _class_codes(groups: Sequence[str]) -> np.ndarray:
    table = np.full(len(RESIDUES) + 1, -1, dtype=np.int64)  # the last place is that of other letters
    for i, members in enumerate(groups):
        table[[RESIDUES.index(r) for r in members]] = i
    return table


def with_ctdt(df: DataFrame, seq: str, classes: Mapping[str, Sequence[str]] = D.CTD_CLASSES) -> DataFrame:
    """Share of neighbouring residues that change class, in either direction."""
    names = [f"CTDT_{name}_{a}{b}" for name in classes for a, b in ("12", "13", "23")]

    def compute(letters: Letters):
        residue, inside, out = letters.residues(), letters.within(1), []
        for groups in classes.values():
            code = _class_codes(groups)[residue]
            a, b = code[inside], code[inside + 1]
            for one, two in ((0, 1), (0, 2), (1, 2)):
                hit = ((a == one) & (b == two)) | ((a == two) & (b == one))
                out.append(_share(letters.sums(hit.astype(np.float64), inside), letters.size - 1))
        return out, letters.null

    return _with_columns(df, seq, names, compute)


def with_autocorrelation(df: DataFrame, seq: str, scales: Mapping[str, Mapping[str, float]], lags: Sequence[int]) -> DataFrame:
    """Moran, Geary and normalised Moreau-Broto values per scale and lag; undefined values are 0."""
    names = [f"{kind}_{name}_lag{lag}" for name in scales for lag in lags for kind in ("Moran", "Geary", "NMBroto")]
    tables = {name: _scale(D.standardised(scale)) for name, scale in scales.items()}

    def compute(letters: Letters):
        residue, size, out = letters.residues(), letters.size, []
        for name in scales:
            v = tables[name][residue]
            mean = _share(letters.sums(v), size)
            off = v - mean[letters.record]
            spread = letters.sums(off * off)
            for lag in lags:
                inside, span = letters.within(lag), size - lag
                guard = lambda top, bottom: np.where((span > 0) & (bottom > 1e-12), top / bottom, 0.0)
                out.append(guard(letters.sums(off[inside] * off[inside + lag], inside) / span, spread / size))
                out.append(guard(letters.sums((v[inside] - v[inside + lag]) ** 2, inside) / (2.0 * span), spread / np.maximum(size - 1, 1)))
                out.append(np.where(span > 0, letters.sums(v[inside] * v[inside + lag], inside) / span, 0.0))
        return out, _foreign(letters, residue)

    return _with_columns(df, seq, names, compute)


def with_covariance(df: DataFrame, seq: str, scales: Mapping[str, Mapping[str, float]], lags: Sequence[int]) -> DataFrame:
    """Auto covariance (same scale) and cross covariance (two scales) per lag."""
    kinds = [(a, b) for a in scales for b in scales]
    names = [f"AC_{a}_lag{lag}" if a == b else f"CC_{a}_{b}_lag{lag}" for a, b in kinds for lag in lags]
    tables = {name: _scale(D.standardised(scale)) for name, scale in scales.items()}

    def compute(letters: Letters):
        residue, size, off = letters.residues(), letters.size, {}
        for name in scales:
            v = tables[name][residue]
            off[name] = v - _share(letters.sums(v), size)[letters.record]
        inside = {lag: letters.within(lag) for lag in lags}
        out = [np.where(size > lag, letters.sums(off[a][inside[lag]] * off[b][inside[lag] + lag], inside[lag]) / (size - lag), 0.0) for a, b in kinds for lag in lags]
        return out, _foreign(letters, residue)

    return _with_columns(df, seq, names, compute)


def with_quasi_order(df: DataFrame, seq: str, distance: Mapping[str, float], lags: int, weight: float = 0.1) -> DataFrame:
    """Coupling numbers and the quasi-sequence-order shares that they weigh down; ``distance`` is keyed by residue pair."""
    squares = np.array([[float(distance[a + b]) ** 2 for b in RESIDUES] for a in RESIDUES])
    steps = range(1, lags + 1)
    names = [f"SOCN_{k}" for k in steps] + [f"QSO_{r}" for r in RESIDUES] + [f"QSO_lag{k}" for k in steps]

    def compute(letters: Letters):
        residue, tau = letters.residues(), []
        for k in steps:
            inside = letters.within(k)
            tau.append(letters.sums(squares[residue[inside], residue[inside + k]], inside))
        bottom = 1.0 + weight * sum(tau)
        shares = _share(letters.counts(residue), letters.size[:, None]) / bottom[:, None]
        return [*tau, *shares.T, *[weight * t / bottom for t in tau]], _foreign(letters, residue)

    return _with_columns(df, seq, names, compute)


def _pseudo(df: DataFrame, seq: str, properties, terms, names, theta, weight: float) -> DataFrame:
    """Letter counts and sequence-order terms, damped by the sum of the terms; ``theta`` adds up one term's products."""
    tables = {n: _scale(D.standardised(p)) for n, p in properties.items()}

    def compute(letters: Letters):
        residue, size = letters.residues(), letters.size
        values, found = {n: t[residue] for n, t in tables.items()}, []
        for term, lag in terms:
            inside, span = letters.within(lag), size - lag
            found.append(np.where(span > 0, theta(letters, values, term, inside, lag) / span, 0.0))
        bottom = 1.0 + weight * sum(found)
        return [*(letters.counts(residue) / bottom[:, None]).T, *[weight * t / bottom for t in found]], _foreign(letters, residue)

    return _with_columns(df, seq, names, compute)


def with_pseudo_composition(df: DataFrame, seq: str, properties: Mapping[str, Mapping[str, float]], lags: int, weight: float = 0.05) -> DataFrame:
    """Pseudo composition: counts damped by sequence-order correlation of several properties at once."""
    def theta(letters, values, _, inside, lag):
        return sum(letters.sums((v[inside] - v[inside + lag]) ** 2, inside) for v in values.values()) / len(values)

    steps = range(1, lags + 1)
    names = [f"PAAC_Xc1.{r}" for r in RESIDUES] + [f"PAAC_Xc2.lambda{k}" for k in steps]
    return _pseudo(df, seq, properties, [(None, k) for k in steps], names, theta, weight)


def with_amphiphilic_composition(df: DataFrame, seq: str, properties: Mapping[str, Mapping[str, float]], lags: int, weight: float = 0.05) -> DataFrame:
    """Amphiphilic pseudo composition: one correlation term per property and lag."""
    def theta(letters, values, n, inside, lag):
        return letters.sums(values[n][inside] * values[n][inside + lag], inside)

    terms = [(n, k) for k in range(1, lags + 1) for n in properties]
    names = [f"APAAC_Pc1.{r}" for r in RESIDUES] + [f"APAAC_Pc2.{n}.{k}" for n, k in terms]
    return _pseudo(df, seq, properties, terms, names, theta, weight)


# --- profiles per group -----------------------------------------------------------------------------

def _grouped(df: DataFrame, by: Sequence[str], seq: str, compute) -> DataFrame:
    """(by, feature, n, total, roots) summed over all records; ``compute`` takes letters and the group of each record.

    It gives (group, feature, n, total) rows. The empty feature counts a group's records, with the sum of the roots of ``sizes``.
    """
    narrow = df.select(*by, F.col(seq).alias("_seq"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def scan(batches):
        for batch in batches:
            for part, letters in _blocks(batch, len(by)):
                keys: dict[tuple, int] = {}
                rows = zip(*(part.column(i).to_pylist() for i in range(len(by)))) if by else [()] * letters.n
                group = np.array([keys.setdefault(k, len(keys)) for k in rows], dtype=np.int64)
                owner, feature, n, total = compute(letters, group, len(keys))
                names = list(keys)
                columns = [pa.array([names[g][i] for g in owner], part.schema.field(i).type) for i in range(len(by))]
                columns += [pa.array(feature, pa.string()), pa.array(n, pa.int64()), pa.array(total, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "feature", "n", "total"])

    parts = narrow.mapInArrow(lambda batches: added_up(scan(batches), [*by, "feature"]), f"{types}{', ' if types else ''}feature string, n long, total double")
    return parts.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _tuples(letters: Letters, code: np.ndarray, k: int, width: int, gap: int):
    """(record, item) of every run of ``width`` letters that are ``gap`` letters apart, and the runs of each record."""
    reach = (width - 1) * (gap + 1)
    inside = letters.within(reach) if reach else np.arange(len(code))
    item = np.zeros(len(inside), dtype=np.int64)
    for i in range(width):
        item = item * k + code[inside + i * (gap + 1)]
    return letters.record[inside], item, np.maximum(letters.size - reach, 0)


def tuple_sums(df: DataFrame, by: Sequence[str], seq: str, kinds: Sequence[tuple[int, int, str]], groups: Mapping[str, str] | None = None, root: bool = False) -> DataFrame:
    """Per group and letter tuple: ``n`` occurrences and ``total``, the sum of 1 / runs of the record (or 1 / its root).

    ``kinds`` lists (letters, letters in between, ending of the feature's name). ``groups`` recodes letters first, others stay.
    The empty feature holds the number of records, and the sum of the roots of their runs of the first kind.
    """
    def compute(letters: Letters, group: np.ndarray, n_groups: int):
        points = letters.code.astype(np.int64)
        if groups:
            table = np.arange(128)
            for sign, members in groups.items():
                table[[ord(m) for m in members]] = ord(sign)
            points = np.where(points < 128, table[np.minimum(points, 127)], points)
        signs, code = np.unique(points, return_inverse=True)
        signs, k = [chr(s) for s in signs], len(signs)
        owner, feature, n, total = [], [], [], []
        roots = None
        for width, gap, ending in kinds:
            record, item, runs = _tuples(letters, code, k, width, gap)
            roots = np.sqrt(runs) if roots is None else roots
            each = 1.0 / np.sqrt(np.maximum(runs, 1)) if root else 1.0 / np.maximum(runs, 1)
            key, spot = np.unique(group[record] * k ** width + item, return_inverse=True)
            owner.append(key // k ** width)
            item = key % k ** width
            names = [ending] * len(key)
            for i in range(width):  # from the last letter to the first
                names = [signs[p] + x for p, x in zip((item // k ** i % k).tolist(), names)]
            feature += names
            n.append(np.bincount(spot, minlength=len(key)))
            total.append(np.bincount(spot, weights=each[record], minlength=len(key)))
        owner.append(np.arange(n_groups))
        feature += [""] * n_groups
        n.append(np.bincount(group, minlength=n_groups))
        total.append(np.bincount(group, weights=roots, minlength=n_groups))
        return np.concatenate(owner).tolist(), feature, np.concatenate(n).astype(np.int64), np.concatenate(total).astype(np.float64)

    return _grouped(df, by, seq, compute)


def _per_record(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the records of the group, ``_rows``, to each feature."""
    rows = sums.where("feature = ''").select(*[F.col(b).alias(f"_{b}") for b in by], F.col("n").alias("_rows"), F.col("total").alias("_roots"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return sums.where("feature <> ''").join(rows, same).drop(*[f"_{b}" for b in by])


def tuple_profile(df: DataFrame, by: Sequence[str], seq: str, kinds: Sequence[tuple[int, int, str]], groups: Mapping[str, str] | None = None, tag: str = "") -> DataFrame:
    """Mean relative frequency of each letter tuple per group, records without it included: (by, feature, n_occurrences, mean_frequency)."""
    out = _per_record(tuple_sums(df, by, seq, kinds, groups), by)
    return out.select(*by, F.concat(F.lit(tag), "feature").alias("feature"), F.col("n").alias("n_occurrences"), (F.col("total") / F.col("_rows")).alias("mean_frequency"))


def dipeptide_deviation_profile(df: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """Mean deviation of dipeptide frequency from its codon expectation, all 400 pairs per group.

    (D - Tm) / sqrt(Tm (1 - Tm) / N) summed over records needs only the sum of count / sqrt(N) and the sum of sqrt(N).
    """
    sums = tuple_sums(df, by, seq, [(2, 0, "")], root=True)
    pairs = F.array(*[F.struct(F.lit(a + b).alias("pair"), F.lit(D.CODONS[a] / 61.0 * (D.CODONS[b] / 61.0)).alias("tm")) for a in RESIDUES for b in RESIDUES])
    grid = sums.where("feature = ''").select(*by, F.col("total").alias("roots"), "n", F.explode(pairs).alias("p")).select(*by, "roots", "n", "p.pair", "p.tm")
    hits = sums.where("feature <> ''").select(*[F.col(b).alias(f"_{b}") for b in by], F.col("feature").alias("_pair"), F.col("total").alias("hit"))
    same = F.col("pair") == F.col("_pair")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    joined = grid.join(hits, same, "left").na.fill(0.0, ["hit"])
    tm = F.col("tm")
    value = (F.col("hit") - tm * F.col("roots")) / F.sqrt(tm * (1.0 - tm)) / F.col("n")
    return joined.select(*by, F.concat(F.lit("DDE_"), "pair").alias("feature"), value.alias("mean_deviation"))


def ctdd_profile(df: DataFrame, by: Sequence[str], seq: str, classes: Mapping[str, Sequence[str]] = D.CTD_CLASSES) -> DataFrame:
    """Mean position, in percent of the length, of the first and the 25/50/75/100 percent member of every class; absent: 0."""
    names = [f"CTDD_{name}_g{i}_p{p}" for name, groups in classes.items() for i in range(1, len(groups) + 1) for p in D.CTD_PERCENTILES]

    def compute(letters: Letters, group: np.ndarray, n_groups: int):
        residue, totals = letters.residues(), []
        for groups in classes.values():
            code = _class_codes(groups)[residue]
            for i in range(len(groups)):
                spots = np.flatnonzero(code == i)
                members = np.bincount(letters.record[spots], minlength=letters.n)
                first = np.cumsum(members) - members
                has = np.flatnonzero(members)
                for p in D.CTD_PERCENTILES:
                    nth = np.zeros(len(has), dtype=np.int64) if p == 1 else np.maximum(np.ceil(p / 100.0 * members[has]).astype(np.int64) - 1, 0)
                    value = (letters.place[spots[first[has] + nth]] + 1) / letters.size[has] * 100.0
                    totals.append(np.bincount(group[has], weights=value, minlength=n_groups))
        rows = np.bincount(group, minlength=n_groups)
        owner = np.tile(np.arange(n_groups), len(names)).tolist()
        return owner, [x for x in names for _ in range(n_groups)], np.tile(rows, len(names)), np.concatenate(totals)

    sums = _grouped(df, by, seq, compute)
    return sums.select(*by, "feature", (F.col("total") / F.col("n")).alias("mean_value"))
