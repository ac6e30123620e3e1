"""Sequence descriptors as column expressions, and their distributed profiles.

Composition descriptors come in two forms: fixed-width columns per record, and for the wide sparse
ones (pairs, triples) an array of occurrences per record. A profile is the mean relative frequency
per group; it explodes occurrences into a partial aggregate, so nothing wide is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scalars import RESIDUES, count_chars, safe_ratio

# --- fixed values: residue scales and groupings ---------------------------------------------------

KD = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
BOMAN = {
    "A": -0.36, "C": -0.41, "D": 3.05, "E": 3.11, "F": -1.33, "G": -0.20, "H": 0.81, "I": -1.75, "K": 2.80, "L": -1.76,
    "M": -0.62, "N": 1.34, "P": -0.40, "Q": 0.73, "R": 2.58, "S": 0.22, "T": 0.11, "V": -1.27, "W": -0.60, "Y": 0.35,
}
# pKa values: groups that gain a proton are positive, groups that lose one are negative.
PKA_N_TERM, PKA_C_TERM = 8.6, 3.6
PKA_POSITIVE = {"K": 10.8, "R": 12.5, "H": 6.0}
PKA_NEGATIVE = {"D": 3.9, "E": 4.1, "C": 8.3, "Y": 10.9}
CTD_CLASSES = {
    "hydrophobicity": ("RKEDQN", "GASTPHY", "CLVIMFW"),
    "polarity": ("LIFWCMVY", "PATGS", "HQRKNED"),
    "polarizability": ("GASDT", "CPNVEQIL", "KMHFRYW"),
    "charge": ("KR", "ANCQGHILMFPSTWYV", "DE"),
    "secondary": ("EALMQKRH", "VIYCWFT", "GNPSD"),
}
CTD_PERCENTILES = (1, 25, 50, 75, 100)
# Number of codons per residue of the standard genetic code (61 sense codons).
CODONS = {
    "A": 4, "C": 2, "D": 2, "E": 2, "F": 2, "G": 4, "H": 2, "I": 3, "K": 2, "L": 6,
    "M": 1, "N": 2, "P": 4, "Q": 2, "R": 6, "S": 6, "T": 4, "V": 4, "W": 1, "Y": 2,
}
# Five physico-chemical groups and seven conjoint-triad classes.
FIVE_GROUPS = {"a": "GAVLMI", "r": "FYW", "p": "KRH", "n": "DE", "u": "STCPNQ"}
SEVEN_CLASSES = {"1": "AGV", "2": "ILFP", "3": "YMTS", "4": "HNQW", "5": "RK", "6": "DE", "7": "C"}
# Pseudo-composition property tables (hydrophobicity, hydrophilicity, side-chain mass).
PSEUDO_PROPERTIES = {
    "Hydrophobicity": {
        "A": 0.62, "C": 0.29, "D": -0.90, "E": -0.74, "F": 1.19, "G": 0.48, "H": -0.40, "I": 1.38, "K": -1.50, "L": 1.06,
        "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.53, "S": -0.18, "T": -0.05, "V": 1.08, "W": 0.81, "Y": 0.26,
    },
    "Hydrophilicity": {
        "A": -0.5, "C": -1.0, "D": 3.0, "E": 3.0, "F": -2.5, "G": 0.0, "H": -0.5, "I": -1.8, "K": 3.0, "L": -1.8,
        "M": -1.3, "N": 0.2, "P": 0.0, "Q": 0.2, "R": 3.0, "S": 0.3, "T": -0.4, "V": -1.5, "W": -3.4, "Y": -2.3,
    },
    "SideChainMass": {
        "A": 15.0, "C": 47.0, "D": 59.0, "E": 73.0, "F": 91.0, "G": 1.0, "H": 82.0, "I": 57.0, "K": 73.0, "L": 57.0,
        "M": 75.0, "N": 58.0, "P": 42.0, "Q": 72.0, "R": 101.0, "S": 31.0, "T": 45.0, "V": 43.0, "W": 130.0, "Y": 107.0,
    },
}


def standardised(scale: Mapping[str, float]) -> dict[str, float]:
    """Zero mean and unit population deviation over the 20 residues."""
    mean = sum(scale.values()) / len(scale)
    sd = math.sqrt(sum((v - mean) ** 2 for v in scale.values()) / len(scale))
    return {k: (v - mean) / sd for k, v in scale.items()}


# --- building blocks -----------------------------------------------------------------------------

def chars(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def recode(seq: Column, groups: Mapping[str, str]) -> Column:
    """Rewrite residues to one-letter group codes in a single pass."""
    source = "".join(groups.values())
    target = "".join(code * len(members) for code, members in groups.items())
    return F.translate(seq, source, target)


def values(seq: Column, scale: Mapping[str, float]) -> Column:
    table = F.array(*[F.lit(float(scale[r])) for r in RESIDUES])
    return F.transform(chars(seq), lambda c: F.element_at(table, F.position(c, F.lit(RESIDUES))))


def shifted(array: Column, lag: Column | int) -> tuple[Column, Column]:
    """The two aligned windows of an array at a lag (both empty when the lag is too long)."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    size = F.greatest(F.size(array) - lag, F.lit(0))
    return F.slice(array, F.lit(1), size), F.slice(array, lag + 1, size)


def pairs(letters: Column, gap: Column | int = 0) -> Column:
    """Ordered letter pairs with ``gap`` letters in between; linear in the length."""
    left, right = shifted(letters, gap + 1)
    return F.zip_with(left, right, lambda a, b: F.concat(a, b))


def triples(letters: Column, gap: int = 0) -> Column:
    a, _ = shifted(letters, 2 * (gap + 1))
    b = F.slice(letters, F.lit(gap + 2), F.size(a))
    c = F.slice(letters, F.lit(2 * gap + 3), F.size(a))
    return F.zip_with(F.zip_with(a, b, lambda x, y: F.concat(x, y)), c, lambda xy, z: F.concat(xy, z))


def skip_pairs(letters: Column) -> Column:
    """Pairs at every gap. Quadratic in the length: meant for length-ruled records."""
    gaps = F.when(F.size(letters) > 1, F.sequence(F.lit(0), F.size(letters) - 2)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(gaps, lambda g: pairs(letters, g)))


def occurrence_profile(df: DataFrame, by: Sequence[str], occurrences: Column, tag: str = "") -> DataFrame:
    """Mean relative frequency of each item per group, zeros included.

    The empty item that every row adds counts the rows, so one scan and one partial aggregate do.
    """
    sized = df.select(*by, occurrences.alias("_items"))
    rows = sized.select(
        *by, (1.0 / F.greatest(F.size("_items"), F.lit(1))).alias("_w"),
        F.explode(F.array_append("_items", F.lit(""))).alias("item"))
    sums = rows.groupBy(*by, "item").agg(F.sum("_w").alias("_sum"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    total = F.max(F.when(F.col("item") == "", F.col("_n"))).over(group)
    out = sums.withColumn("_rows", total).where("item <> ''")
    return out.select(
        *by, F.concat(F.lit(tag), "item").alias("feature"), F.col("_n").alias("n_occurrences"), (F.col("_sum") / F.col("_rows")).alias("mean_frequency"))


def gapped_pair_profile(df: DataFrame, by: Sequence[str], letters: Column, gaps: Sequence[int]) -> DataFrame:
    """Pair profile at several gaps; every gap has its own denominator, all from one scan."""
    cut = df.select(*by, letters.alias("_letters"))
    tagged = F.concat(*[
        F.transform(F.array(pairs(F.col("_letters"), g)), lambda p: F.struct(F.lit(g).alias("gap"), p.alias("items"))) for g in gaps])
    rows = cut.select(*by, F.explode(tagged).alias("_e")).select(*by, "_e.gap", "_e.items")
    out = occurrence_profile(rows, [*by, "gap"], F.col("items"))
    name = F.concat("feature", F.lit(".gap"), F.col("gap").cast("string"))
    return out.withColumn("feature", name).drop("gap")


# --- physico-chemical vector ----------------------------------------------------------------------

def scale_sum(seq: Column, scale: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for residue in RESIDUES:
        total = total + count_chars(seq, residue) * scale[residue]
    return total


def ionisable_counts(seq: Column) -> Column:
    return F.struct(*[count_chars(seq, r).alias(r) for r in (*PKA_POSITIVE, *PKA_NEGATIVE)])


def charge_at(counts: Column, ph: Column) -> Column:
    up = lambda pka: 1.0 / (1.0 + F.pow(F.lit(10.0), ph - pka))
    down = lambda pka: 1.0 / (1.0 + F.pow(F.lit(10.0), F.lit(pka) - ph))
    total = up(PKA_N_TERM) - down(PKA_C_TERM)
    for residue, pka in PKA_POSITIVE.items():
        total = total + counts[residue] * up(pka)
    for residue, pka in PKA_NEGATIVE.items():
        total = total - counts[residue] * down(pka)
    return total


def net_charge(seq: Column, ph: float = 7.4) -> Column:
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(charge_at(ionisable_counts(seq), F.lit(ph)))


def isoelectric_point(counts: Column, steps: int = 60) -> Column:
    """Bisection of the falling charge curve on [0, 14] down to double precision.

    The step widths are fixed (7, 3.5, ...), so the fold keeps only the lower end. The counts go
    in as a lambda variable, which keeps them from being computed again in every step.
    """
    widths = F.array(*[F.lit(14.0 / 2**k) for k in range(1, steps + 1)])
    solve = lambda n: F.aggregate(
        widths, F.lit(0.0), lambda low, width: low + F.when(charge_at(n, low + width) > 0, width).otherwise(F.lit(0.0)))
    return F.get(F.transform(F.array(counts), solve), F.lit(0))


def hydrophobic_moment(seq: Column, scale: Mapping[str, float] = KD, degrees: float = 100.0) -> Column:
    angle = math.radians(degrees)
    part = lambda trig: F.aggregate(
        F.transform(values(seq, scale), lambda v, i: v * trig(i * angle)), F.lit(0.0), lambda a, x: a + x)
    size = F.length(seq)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.sqrt(F.pow(part(F.cos), F.lit(2)) + F.pow(part(F.sin), F.lit(2))) / size)


PHYS8 = ("length_norm", "net_charge", "hydrophobicity", "boman", "aliphatic_index", "pi_norm", "aromaticity", "hydrophobic_moment")


def with_phys8(df: DataFrame, seq: str = "sequence") -> DataFrame:
    """Eight normalised descriptors; all zero for an empty sequence."""
    s, size = F.col(seq), F.length(seq)
    counted = df.withColumn("_ion", ionisable_counts(s))
    aliphatic = count_chars(s, "A") + 2.9 * count_chars(s, "V") + 3.9 * count_chars(s, "IL")
    raw = (
        size / 100.0, net_charge(s) / 10.0, scale_sum(s, KD) / size / 4.5, scale_sum(s, BOMAN) / size / 3.0,
        aliphatic / size * 100.0 / 150.0, isoelectric_point(F.col("_ion")) / 14.0, count_chars(s, "FYW") / size, hydrophobic_moment(s) / 2.0)
    guard = lambda v: F.when(size == 0, F.lit(0.0)).otherwise(v)
    return counted.select("*", *[guard(v).alias(f"phys8_{n}") for n, v in zip(PHYS8, raw)]).drop("_ion")


# --- composition, transition, distribution ----------------------------------------------------------

def aac(seq: Column) -> list[Column]:
    return [safe_ratio(count_chars(seq, r), F.length(seq)).alias(f"AAC_{r}") for r in RESIDUES]


def grouped_composition(seq: Column, groups: Mapping[str, str] = FIVE_GROUPS) -> list[Column]:
    return [safe_ratio(count_chars(seq, members), F.length(seq)).alias(f"GAAC_{code}") for code, members in groups.items()]


def ctdc(seq: Column, classes: Mapping[str, Sequence[str]] = CTD_CLASSES) -> list[Column]:
    return [
        safe_ratio(count_chars(seq, members), F.length(seq)).alias(f"CTDC_{name}_g{i}")
        for name, groups in classes.items() for i, members in enumerate(groups, 1)]


def _classed(seq: Column, groups: Sequence[str]) -> Column:
    return recode(seq, {str(i): members for i, members in enumerate(groups, 1)})


def ctdt(seq: Column, classes: Mapping[str, Sequence[str]] = CTD_CLASSES) -> list[Column]:
    """Share of neighbouring residues that change class, in either direction.

    '12' cannot overlap itself, so the length lost by deleting it counts every occurrence.
    """
    out = []
    for name, groups in classes.items():
        coded = _classed(seq, groups)
        seen = lambda two: (F.length(coded) - F.length(F.replace(coded, F.lit(two), F.lit("")))) / 2
        for a, b in (("1", "2"), ("1", "3"), ("2", "3")):
            out.append(safe_ratio(seen(a + b) + seen(b + a), F.length(seq) - 1).alias(f"CTDT_{name}_{a}{b}"))
    return out


def ctdd(seq: Column, classes: Mapping[str, Sequence[str]] = CTD_CLASSES) -> Column:
    """Position, in percent of the length, of the first and the 25/50/75/100 percent member of every
    class, as an array of (feature, value); an absent class gives zeros."""
    entries = []
    for name, groups in classes.items():
        coded = chars(_classed(seq, groups))
        for i in range(1, len(groups) + 1):
            places = F.array_compact(F.transform(coded, lambda c, at: F.when(c == str(i), at + 1)))
            entries.append(F.transform(
                F.array(places), lambda p: F.array(*[
                    F.struct(
                        F.lit(f"CTDD_{name}_g{i}_p{pct}").alias("feature"),
                        F.coalesce(F.get(p, _member(F.size(p), pct)) / F.length(seq) * 100.0, F.lit(0.0)).alias("value"))
                    for pct in CTD_PERCENTILES])))
    return F.flatten(F.flatten(F.array(*entries)))


def _member(n: Column, percent: int) -> Column:
    return F.lit(0) if percent == 1 else F.greatest(F.ceil(percent / 100.0 * n) - 1, F.lit(0)).cast("int")


def dipeptide_deviation_profile(df: DataFrame, by: Sequence[str], seq: str) -> DataFrame:
    """Mean deviation of dipeptide frequency from its codon expectation, all 400 pairs per group.

    (D - Tm) / sqrt(Tm (1 - Tm) / N) summed over records needs only the sum of count / sqrt(N) and the
    sum of sqrt(N), so occurrences aggregate map-side. Records without a pair count as zero.
    """
    items = df.select(*by, pairs(chars(F.col(seq))).alias("_p"))
    rows = items.select(*by, F.size("_p").alias("_n"), F.explode(F.array_append("_p", F.lit(""))).alias("pair"))
    sums = rows.groupBy(*by, "pair").agg(
        F.sum(F.when(F.col("_n") > 0, 1.0 / F.sqrt("_n")).otherwise(0.0)).alias("hit"),
        F.sum(F.sqrt("_n")).alias("roots"), F.count("*").alias("n"))
    share = F.array(*[F.lit(CODONS[r] / 61.0) for r in RESIDUES])
    letter = F.split(F.lit(RESIDUES), "")
    first, second = F.floor(F.col("_i") / 20).cast("int"), (F.col("_i") % 20).cast("int")
    groups = sums.where("pair = ''").select(*by, "roots", "n")
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("_i")).select(
        *by, "roots", "n", F.concat(F.get(letter, first), F.get(letter, second)).alias("pair"),
        (F.get(share, first) * F.get(share, second)).alias("tm"))
    joined = grid.join(sums.select(*by, "pair", "hit"), [*by, "pair"], "left").na.fill(0.0, ["hit"])
    tm = F.col("tm")
    value = (F.col("hit") - tm * F.col("roots")) / F.sqrt(tm * (1.0 - tm)) / F.col("n")
    return joined.select(*by, F.concat(F.lit("DDE_"), "pair").alias("feature"), value.alias("mean_deviation"))


# --- autocorrelation and sequence order --------------------------------------------------------------

def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _lag_sum(a: Column, b: Column, lag: int, term) -> Column:
    left, _ = shifted(a, lag)
    _, right = shifted(b, lag)
    return _sum(F.zip_with(left, right, term))


def autocorrelation(df: DataFrame, seq: str, scales: Mapping[str, Mapping[str, float]], lags: Sequence[int]) -> DataFrame:
    """Moran, Geary and normalised Moreau-Broto values per scale and lag; undefined values are 0."""
    for name, scale in scales.items():
        df = df.withColumn(f"_v_{name}", values(F.col(seq), standardised(scale)))
        df = df.withColumn(f"_m_{name}", safe_ratio(_sum(F.col(f"_v_{name}")), F.size(f"_v_{name}")))
    out = []
    for name in scales:
        v, mean = F.col(f"_v_{name}"), F.col(f"_m_{name}")
        size = F.size(v)
        spread = _sum(F.transform(v, lambda x: (x - mean) * (x - mean)))
        for lag in lags:
            span = size - lag
            guard = lambda top, bottom: F.when((span > 0) & (bottom > 1e-12), top / bottom).otherwise(F.lit(0.0))
            moran = _lag_sum(v, v, lag, lambda a, b: (a - mean) * (b - mean)) / span
            geary = _lag_sum(v, v, lag, lambda a, b: (a - b) * (a - b)) / (2.0 * span)
            broto = _lag_sum(v, v, lag, lambda a, b: a * b)
            out += [
                guard(moran, spread / size).alias(f"Moran_{name}_lag{lag}"),
                guard(geary, spread / F.greatest(size - 1, F.lit(1))).alias(f"Geary_{name}_lag{lag}"),
                F.when(span > 0, broto / span).otherwise(F.lit(0.0)).alias(f"NMBroto_{name}_lag{lag}")]
    return df.select("*", *out).drop(*[f"_{k}_{n}" for n in scales for k in "vm"])


def covariance(df: DataFrame, seq: str, scales: Mapping[str, Mapping[str, float]], lags: Sequence[int]) -> DataFrame:
    """Auto covariance (same scale) and cross covariance (two scales) per lag."""
    for name, scale in scales.items():
        v = values(F.col(seq), standardised(scale))
        df = df.withColumn(f"_v_{name}", v)
        mean = safe_ratio(_sum(F.col(f"_v_{name}")), F.size(f"_v_{name}"))
        df = df.withColumn(f"_m_{name}", mean)
    out = []
    for a in scales:
        for b in scales:
            kind = "AC" if a == b else "CC"
            label = a if a == b else f"{a}_{b}"
            ma, mb = F.col(f"_m_{a}"), F.col(f"_m_{b}")
            for lag in lags:
                span = F.size(f"_v_{a}") - lag
                total = _lag_sum(F.col(f"_v_{a}"), F.col(f"_v_{b}"), lag, lambda x, y: (x - ma) * (y - mb))
                out.append(F.when(span > 0, total / span).otherwise(F.lit(0.0)).alias(f"{kind}_{label}_lag{lag}"))
    return df.select("*", *out).drop(*[f"_{k}_{n}" for n in scales for k in "vm"])


def order_coupling(seq: Column, distance: Mapping[str, float], lag: int) -> Column:
    """Sum of squared residue distances at a lag; ``distance`` is keyed by residue pair."""
    table = F.create_map(*[x for k, v in sorted(distance.items()) for x in (F.lit(k), F.lit(float(v)))])
    return _sum(F.transform(pairs(chars(seq), lag - 1), lambda p: F.pow(F.element_at(table, p), F.lit(2))))


def with_quasi_order(df: DataFrame, seq: str, distance: Mapping[str, float], lags: int, weight: float = 0.1) -> DataFrame:
    """Coupling numbers and the quasi-sequence-order shares that they weigh down."""
    s = F.col(seq)
    df = df.select("*", *[order_coupling(s, distance, k).alias(f"SOCN_{k}") for k in range(1, lags + 1)])
    total = sum((F.col(f"SOCN_{k}") for k in range(1, lags + 1)), F.lit(0.0))
    bottom = 1.0 + weight * total
    shares = [(safe_ratio(count_chars(s, r), F.length(s)) / bottom).alias(f"QSO_{r}") for r in RESIDUES]
    tails = [(weight * F.col(f"SOCN_{k}") / bottom).alias(f"QSO_lag{k}") for k in range(1, lags + 1)]
    return df.select("*", *shares, *tails)


def with_pseudo_composition(df: DataFrame, seq: str, properties: Mapping[str, Mapping[str, float]], lags: int,
                            weight: float = 0.05) -> DataFrame:
    """Pseudo composition: counts damped by sequence-order correlation of several properties at once."""
    s = F.col(seq)
    names = list(properties)
    for n in names:
        df = df.withColumn(f"_v_{n}", values(s, standardised(properties[n])))
    thetas = []
    for lag in range(1, lags + 1):
        span = F.length(s) - lag
        total = sum((_lag_sum(F.col(f"_v_{n}"), F.col(f"_v_{n}"), lag, lambda a, b: (a - b) * (a - b)) for n in names), F.lit(0.0))
        thetas.append(F.when(span > 0, total / len(names) / span).otherwise(F.lit(0.0)).alias(f"_t{lag}"))
    df = df.select("*", *thetas)
    bottom = 1.0 + weight * sum((F.col(f"_t{k}") for k in range(1, lags + 1)), F.lit(0.0))
    first = [(count_chars(s, r) / bottom).alias(f"PAAC_Xc1.{r}") for r in RESIDUES]
    second = [(weight * F.col(f"_t{k}") / bottom).alias(f"PAAC_Xc2.lambda{k}") for k in range(1, lags + 1)]
    return df.select("*", *first, *second).drop(*[f"_v_{n}" for n in names], *[f"_t{k}" for k in range(1, lags + 1)])


def with_amphiphilic_composition(df: DataFrame, seq: str, properties: Mapping[str, Mapping[str, float]], lags: int,
                                 weight: float = 0.05) -> DataFrame:
    """Amphiphilic pseudo composition: one correlation term per property and lag."""
    s = F.col(seq)
    terms = [(n, lag) for lag in range(1, lags + 1) for n in properties]
    for n in properties:
        df = df.withColumn(f"_v_{n}", values(s, standardised(properties[n])))
    thetas = []
    for n, lag in terms:
        span = F.length(s) - lag
        total = _lag_sum(F.col(f"_v_{n}"), F.col(f"_v_{n}"), lag, lambda a, b: a * b)
        thetas.append(F.when(span > 0, total / span).otherwise(F.lit(0.0)).alias(f"_t_{n}_{lag}"))
    df = df.select("*", *thetas)
    bottom = 1.0 + weight * sum((F.col(f"_t_{n}_{lag}") for n, lag in terms), F.lit(0.0))
    first = [(count_chars(s, r) / bottom).alias(f"APAAC_Pc1.{r}") for r in RESIDUES]
    second = [(weight * F.col(f"_t_{n}_{lag}") / bottom).alias(f"APAAC_Pc2.{n}.{lag}") for n, lag in terms]
    return df.select("*", *first, *second).drop(*[f"_v_{n}" for n in properties], *[f"_t_{n}_{lag}" for n, lag in terms])


# --- triads and reduced alphabets ----------------------------------------------------------------------

def triad_shares(letters: Column, gap: int, n_features: int) -> Column:
    """(triad, (count - min) / max) of one record; the minimum is 0 unless every triad occurs.

    Counting inside the record is quadratic in its length, so this is for length-ruled records.
    """
    def shares(found: Column) -> Column:
        counts = F.transform(F.array_distinct(found), lambda x: F.struct(
            x.alias("triad"), F.size(F.filter(found, lambda y: y == x)).alias("n")))
        return F.get(F.transform(F.array(counts), scale), F.lit(0))

    def scale(counts: Column) -> Column:
        numbers = F.transform(counts, lambda k: k["n"])
        low = F.when(F.size(counts) < n_features, F.lit(0)).otherwise(F.array_min(numbers))
        return F.transform(counts, lambda k: F.struct(
            k["triad"].alias("triad"), ((k["n"] - low) / F.array_max(numbers)).alias("share")))

    # Lambda variables hold the triads and the counts, so neither is computed again per element.
    return F.get(F.transform(F.array(triples(letters, gap)), shares), F.lit(0))


def triad_profile(df: DataFrame, by: Sequence[str], seq: str, gaps: Sequence[int], classes: Mapping[str, str] = SEVEN_CLASSES) -> DataFrame:
    """Mean normalised triad share per group and gap, zeros included; one scan for all gaps."""
    letters = chars(recode(F.col(seq), classes))
    per_gap = F.concat(*[
        F.transform(triad_shares(letters, g, len(classes) ** 3), lambda s: F.struct(
            F.concat(s["triad"], F.lit(f".gap{g}")).alias("feature"), s["share"].alias("share"))) for g in gaps])
    mark = F.struct(F.lit("").alias("feature"), F.lit(0.0).alias("share"))
    rows = df.select(*by, F.explode(F.array_append(per_gap, mark)).alias("e")).select(*by, "e.feature", "e.share")
    sums = rows.groupBy(*by, "feature").agg(F.sum("share").alias("total"), F.count("*").alias("n"))
    n_rows = F.max(F.when(F.col("feature") == "", F.col("n"))).over(Window.partitionBy(*by))
    return sums.withColumn("_rows", n_rows).where("feature <> ''").select(
        *by, "feature", (F.col("total") / F.col("_rows")).alias("mean_share"))


def reduced_composition(df: DataFrame, by: Sequence[str], seq: str, clusters: Mapping[str, str], k: int, gap: int = 0) -> DataFrame:
    """k-mer composition over a user-supplied residue clustering (k = 1, 2 or 3), with a gap between letters."""
    letters = chars(recode(F.col(seq), clusters))
    items = {1: letters, 2: pairs(letters, gap), 3: triples(letters, gap)}[k]
    return occurrence_profile(df, by, items)


def distance_pairs(df: DataFrame, by: Sequence[str], seq: str, max_distance: int, clusters: Mapping[str, str] | None = None) -> DataFrame:
    """Letter frequency (distance 0) and pair frequency at each distance, on a reduced alphabet if given."""
    letters = chars(recode(F.col(seq), clusters) if clusters else F.col(seq))
    out = occurrence_profile(df, by, letters, "DP_")
    for d in range(1, max_distance + 1):
        out = out.unionByName(occurrence_profile(df, by, F.transform(pairs(letters, d - 1), lambda p: F.concat(p, F.lit(f".d{d}"))), "DP_"))
    return out


# --- embeddings --------------------------------------------------------------------------------------------

def mean_pool(tokens: Column) -> Column:
    """Mean token vector without the start and the end token; ARRAY<ARRAY<FLOAT>> to ARRAY<DOUBLE>."""
    inner = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    width = F.size(F.get(tokens, F.lit(0)))
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    total = F.aggregate(inner, zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: F.try_divide(x, F.size(inner)))


def mean_vector(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Mean vector per group in long form (group, dim, value); combines map-side."""
    return df.select(*by, F.posexplode(vector).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
