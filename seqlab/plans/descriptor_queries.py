"""Quality vectors, sequence descriptors and feature-name queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import composition as Q, descriptors as D, scalars as S
from ..functions.scalars import RESIDUES
from ..operators import features as FE, ordered_counts as OC, record_vectors as RV
from . import base as B
from .registry import query

c = F.col
R = B.r6_sql
COUNT = B.count_sql


# --- quality vector -----------------------------------------------------------------------------

QC_SQL = B.FRAGS + f""",
residue AS MATERIALIZED (SELECT record_id, i, substr(seq, i, 1) AS c FROM (SELECT record_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM frags)),
counts AS (SELECT record_id, c, count(*) AS n FROM residue GROUP BY ALL),
shape AS (SELECT record_id, list(n ORDER BY n DESC) AS ns, sum(n) AS size FROM counts GROUP BY 1),
ent AS (SELECT record_id, -sum(n / size * ln(n / size)) / ln(20) AS entropy_norm, any_value(size) AS size, any_value(ns) AS ns
        FROM counts JOIN shape USING (record_id) GROUP BY 1),
runs AS (SELECT record_id, max(n) AS longest_run FROM (SELECT record_id, c, g, count(*) AS n FROM (
   SELECT record_id, c, i - row_number() OVER (PARTITION BY record_id, c ORDER BY i) AS g FROM residue) GROUP BY ALL) GROUP BY 1),
base AS MATERIALIZED (SELECT f.record_id, f.doc_id, f.source, f.lang, f.seq, CAST(length(seq) AS BIGINT) AS length, length(seq) BETWEEN 10 AND 50 AS valid_length,
   starts_with(seq, 'M') AS m_start, contains(seq, 'C') AS contains_c, {COUNT('seq', 'C')} / length(seq) AS c_fraction,
   ns[1] / size AS top1_fraction, list_sum(ns[1:2]) / size AS top2_fraction, entropy_norm, longest_run,
   {COUNT('seq', 'GF')} / length(seq) AS gly_phe_fraction, {COUNT('seq', 'KRH')} / length(seq) AS basic_fraction,
   {COUNT('seq', 'DE')} / length(seq) AS acidic_fraction, {COUNT('seq', 'FWY')} / length(seq) AS aromatic_fraction
   FROM frags f JOIN ent USING (record_id) JOIN runs USING (record_id)),
qc AS MATERIALIZED (SELECT *, valid_length AND NOT low_complexity AND NOT homopolymer AND NOT gf_rich AS qc_pass FROM (
  SELECT *, top1_fraction >= 0.35 OR top2_fraction >= 0.60 OR entropy_norm <= 0.60 AS low_complexity, longest_run >= 4 AS homopolymer,
         gly_phe_fraction >= 0.35 AS gf_rich FROM base))"""


def _qc(t, limit: float = Q.ENTROPY_LIMIT):
    return Q.with_qc(B.fragments(t), "seq", limit)


@query("D01_entropy", B.with_sql(QC_SQL, f"SELECT record_id, {R('entropy_norm')} AS entropy_norm FROM qc"))
def _(t):
    return B.fragments(t).withColumn("n", Q.char_counts(c("seq"))).select(
        "record_id", S.r6(Q.entropy_norm(c("n"), F.length("seq"))).alias("entropy_norm"))


@query("D02_longest_run", B.with_sql(QC_SQL, "SELECT record_id, CAST(longest_run AS BIGINT) AS longest_run FROM runs"))
def _(t):
    return B.fragments(t).select("record_id", Q.longest_run(c("seq")).cast("long").alias("longest_run"))


@query("D03_top_fractions", B.with_sql(QC_SQL, f"SELECT record_id, {R('top1_fraction')} AS top1, {R('top2_fraction')} AS top2 FROM qc"))
def _(t):
    return _qc(t).select("record_id", S.r6(c("top1_fraction")).alias("top1"), S.r6(c("top2_fraction")).alias("top2"))


FRACTIONS = ("c_fraction", "gly_phe_fraction", "basic_fraction", "aromatic_fraction")


@query("D04_qc_vector", B.with_sql(QC_SQL, f"SELECT record_id, length, valid_length, m_start, contains_c, {', '.join(f'{R(k)} AS {k}' for k in FRACTIONS)} FROM qc"))
def _(t):
    return _qc(t).select("record_id", c("length").cast("long").alias("length"), "valid_length", "m_start", "contains_c", *[S.r6(c(k)).alias(k) for k in FRACTIONS])


@query("D05_qc_flags", B.with_sql(QC_SQL, "SELECT record_id, low_complexity, homopolymer, gf_rich, qc_pass FROM qc"))
def _(t):
    return _qc(t).select("record_id", "low_complexity", "homopolymer", "gf_rich", "qc_pass")


@query("D06_audit_vector", B.with_sql(QC_SQL, f"""
SELECT record_id, top1_fraction >= 0.35 OR top2_fraction >= 0.60 OR entropy_norm <= 0.55 AS low_complexity, {R('acidic_fraction')} AS acidic_fraction,
       {R(f"{COUNT('seq', 'KR')} + 0.1::DOUBLE * {COUNT('seq', 'H')} - {COUNT('seq', 'DE')}")} AS net_charge_simple FROM qc"""))
def _(t):
    return _qc(t, Q.AUDIT_ENTROPY_LIMIT).select(
        "record_id", "low_complexity", S.r6(c("acidic_fraction")).alias("acidic_fraction"), S.r6(Q.simple_charge(c("seq"))).alias("net_charge_simple"))


# --- physico-chemical vector ---------------------------------------------------------------------------

def charge_sql(ph: str, seq: str = "seq") -> str:
    up = lambda pka: f"1.0::DOUBLE / (1.0 + pow(10.0::DOUBLE, {ph} - {pka}))"
    down = lambda pka: f"1.0::DOUBLE / (1.0 + pow(10.0::DOUBLE, {pka} - {ph}))"
    terms = [up(D.PKA_N_TERM), f"- {down(D.PKA_C_TERM)}"]
    terms += [f"+ n{r} * {up(p)}" for r, p in D.PKA_POSITIVE.items()]
    terms += [f"- n{r} * {down(p)}" for r, p in D.PKA_NEGATIVE.items()]
    return "(" + " ".join(terms) + ")"


ION = B.FRAGS + ", ion AS MATERIALIZED (SELECT record_id, seq, " + ", ".join(
    f"{COUNT('seq', r)} AS n{r}" for r in (*D.PKA_POSITIVE, *D.PKA_NEGATIVE)) + " FROM frags)"
PI = ION + f""",
curve(record_id, step, lo, hi, mid) AS (
  SELECT record_id, 0, 0.0::DOUBLE, 14.0::DOUBLE, 7.0::DOUBLE FROM ion
  UNION ALL
  SELECT record_id, step + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END, m FROM (
    SELECT k.record_id, step, lo, hi, (lo + hi) / 2.0 AS m, {charge_sql('((lo + hi) / 2.0)')} > 0 AS up FROM curve k JOIN ion USING (record_id) WHERE step < 100)),
pi AS MATERIALIZED (SELECT record_id, mid AS pi FROM curve WHERE step = 100)"""


def scale_sql(scale, seq: str = "seq") -> str:
    return "(" + " + ".join(f"{COUNT(seq, r)} * ({scale[r]}::DOUBLE)" for r in RESIDUES) + ")"


def case_sql(scale, char: str = "c") -> str:
    return "CASE " + char + " " + " ".join(f"WHEN '{r}' THEN {scale[r]!r}::DOUBLE" for r in RESIDUES) + " END"


MOMENT = f""", moment AS MATERIALIZED (SELECT record_id, sqrt(pow(sum(v * cos(radians(100) * (i - 1))), 2) + pow(sum(v * sin(radians(100) * (i - 1))), 2)) / count(*) AS moment
  FROM (SELECT record_id, i, {case_sql(D.KD, "substr(seq, i, 1)")} AS v FROM (SELECT record_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM frags)) GROUP BY 1)"""


@query("D07_net_charge", B.with_sql(ION, f"SELECT record_id, {R(charge_sql('7.4'))} AS net_charge FROM ion"))
def _(t):
    return B.fragments(t).select("record_id", S.r6(D.net_charge(c("seq"))).alias("net_charge"))


@query("D08_isoelectric_point", "WITH RECURSIVE " + PI + f" SELECT record_id, {R('pi')} AS pi FROM pi")
def _(t):
    counted = B.fragments(t).select("record_id", D.ionisable_counts(c("seq")).alias("ion"))
    return counted.select("record_id", S.r6(D.isoelectric_point(c("ion"))).alias("pi"))


@query("D09_hydrophobic_moment", B.with_sql(B.FRAGS + MOMENT, f"SELECT record_id, {R('moment')} AS moment FROM moment"))
def _(t):
    return B.fragments(t).select("record_id", S.r6(D.hydrophobic_moment(c("seq"))).alias("moment"))


PHYS_SQL = f"""SELECT f.record_id, {R('length(seq) / 100.0')} AS phys8_length_norm, {R(charge_sql('7.4') + ' / 10.0')} AS phys8_net_charge,
  {R(scale_sql(D.KD) + ' / length(seq) / 4.5')} AS phys8_hydrophobicity, {R(scale_sql(D.BOMAN) + ' / length(seq) / 3.0')} AS phys8_boman,
  {R(f"({COUNT('seq', 'A')} + 2.9::DOUBLE * {COUNT('seq', 'V')} + 3.9::DOUBLE * {COUNT('seq', 'IL')}) / length(seq) * 100.0 / 150.0")} AS phys8_aliphatic_index,
  {R('pi / 14.0')} AS phys8_pi_norm, {R(COUNT('seq', 'FYW') + ' / length(seq)')} AS phys8_aromaticity, {R('moment / 2.0')} AS phys8_hydrophobic_moment
FROM ion f JOIN pi USING (record_id) JOIN moment USING (record_id)"""


@query("D10_phys8", "WITH RECURSIVE " + PI + MOMENT + PHYS_SQL)
def _(t):
    df = RV.with_phys8(B.fragments(t).select("record_id", "seq"), "seq")
    return df.select("record_id", *[S.r6(c(f"phys8_{n}")).alias(f"phys8_{n}") for n in D.PHYS8])


# --- composition, transition, distribution ----------------------------------------------------------------

def _rounded(df, columns):
    wide = df.select("record_id", *columns)
    return wide.select("record_id", *[S.r6(c(f"`{n}`")).alias(n) for n in wide.columns if n != "record_id"])


@query("D11_aac", B.with_sql(B.FRAGS, "SELECT record_id, " + ", ".join(f'{R(COUNT("seq", r) + " / length(seq)")} AS "AAC_{r}"' for r in RESIDUES) + " FROM frags"))
def _(t):
    return _rounded(B.fragments(t), D.aac(c("seq")))


def profile_sql(unit: str, table: str = "frags", by: str = "source", size: str = "len(items)", tag: str = "") -> str:
    """Mean relative frequency per group of the items that ``unit`` lists for one record."""
    return f""", listed AS MATERIALIZED (SELECT {by} AS grp, {unit} AS items FROM {table}),
n_rows AS (SELECT grp, count(*) AS n_rec FROM listed GROUP BY 1),
profile AS (SELECT grp, item, count(*) AS n, sum(1.0::DOUBLE / size) AS total FROM (SELECT grp, unnest(items) AS item, {size} AS size FROM listed) GROUP BY ALL)
SELECT grp AS {by}, '{tag}' || item AS feature, n AS n_occurrences, {R('total / n_rec')} AS mean_frequency FROM profile JOIN n_rows USING (grp)"""


def _profile(t, by, width, gap=0, groups=None):
    out = RV.tuple_profile(B.fragments(t), [by], "seq", [(width, gap, "")], groups)
    return out.withColumn("mean_frequency", S.r6(c("mean_frequency")))


def at(seq: str, gap: int) -> str:
    return f"list_transform(range(1, greatest(length({seq}) - {gap}, 1)), lambda i: substr({seq}, i, 1) || substr({seq}, i + {gap + 1}, 1))"


def tri(seq: str, gap: int) -> str:
    return (f"list_transform(range(1, greatest(length({seq}) - {2 * gap + 1}, 1)), lambda i: substr({seq}, i, 1) || "
            f"substr({seq}, i + {gap + 1}, 1) || substr({seq}, i + {2 * gap + 2}, 1))")


def recode_sql(seq: str, groups) -> str:
    return f"translate({seq}, '{''.join(groups.values())}', '{''.join(k * len(v) for k, v in groups.items())}')"


def coded(groups, table: str = "frags", seq: str = "seq", by: str = "source") -> str:
    return f", coded AS MATERIALIZED (SELECT {by}, record_id, {recode_sql(seq, groups)} AS z FROM {table})"


@query("D12_dpc_profile", B.with_sql(B.FRAGS, profile_sql(at("seq", 0)).lstrip()))
def _(t):
    return _profile(t, "source", 2)


@query("D13_ctdc", B.with_sql(B.FRAGS, "SELECT record_id, " + ", ".join(
    f'{R(COUNT("seq", m) + " / length(seq)")} AS "CTDC_{name}_g{i}"' for name, g in D.CTD_CLASSES.items() for i, m in enumerate(g, 1)) + " FROM frags"))
def _(t):
    return _rounded(B.fragments(t), D.ctdc(c("seq")))


def _ctdt_sql() -> str:
    parts = []
    for name, groups in D.CTD_CLASSES.items():
        z = recode_sql("seq", {str(i): m for i, m in enumerate(groups, 1)})
        for a, b in (("1", "2"), ("1", "3"), ("2", "3")):
            hits = f"len(list_filter(range(1, length(z_{name})), lambda i: substr(z_{name}, i, 2) IN ('{a}{b}', '{b}{a}')))"
            parts.append((name, z, f'CASE WHEN length(seq) < 2 THEN 0.0 ELSE {R(f"{hits} / (length(seq) - 1)")} END AS "CTDT_{name}_{a}{b}"'))
    codes = ", ".join(f"{z} AS z_{n}" for n, z in {n: z for n, z, _ in parts}.items())
    return f"SELECT record_id, {', '.join(p for _, _, p in parts)} FROM (SELECT record_id, seq, {codes} FROM frags)"


@query("D14_ctdt", B.with_sql(B.FRAGS, _ctdt_sql()))
def _(t):
    df = RV.with_ctdt(B.fragments(t).select("record_id", "seq"), "seq")
    return _rounded(df, [n for n in df.columns if n.startswith("CTDT_")])


def _ctdd_sql() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT record_id, source, length(seq) AS size, '{name}' AS prop, {recode_sql('seq', {str(i): m for i, m in enumerate(g, 1)})} AS z FROM frags"
        for name, g in D.CTD_CLASSES.items())
    picks = ", ".join(
        "places[1] / size * 100.0 AS p1" if p == 1 else f"places[CAST(greatest(ceil({p} / 100.0::DOUBLE * len(places)), 1) AS BIGINT)] / size * 100.0 AS p{p}"
        for p in D.CTD_PERCENTILES)
    return f""", z AS ({kinds}),
p AS (SELECT record_id, source, prop, size, substr(z, i, 1) AS cls, list(i ORDER BY i) AS places FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM z) GROUP BY ALL),
q AS (SELECT source, prop, cls, {picks} FROM p),
s AS (SELECT source, prop, cls, sum(p1) AS p1, sum(p25) AS p25, sum(p50) AS p50, sum(p75) AS p75, sum(p100) AS p100 FROM q GROUP BY ALL),
n AS (SELECT source, count(*) AS n FROM frags GROUP BY 1),
l AS (UNPIVOT s ON p1, p25, p50, p75, p100 INTO NAME pct VALUE total)
SELECT l.source, 'CTDD_' || prop || '_g' || cls || '_' || pct AS feature, {R('total / n.n')} AS mean_value FROM l JOIN n ON l.source = n.source"""


@query("D15_ctdd_profile", B.with_sql(B.FRAGS, _ctdd_sql().lstrip()))
def _(t):
    return RV.ctdd_profile(B.fragments(t), ["source"], "seq").withColumn("mean_value", S.r6(c("mean_value")))


def _dde_sql() -> str:
    grid = ", ".join(f"('{a}{b}', {D.CODONS[a] / 61.0 * D.CODONS[b] / 61.0!r}::DOUBLE)" for a in RESIDUES for b in RESIDUES)
    return f""", listed AS MATERIALIZED (SELECT source, record_id, {at('seq', 0)} AS items FROM frags),
tm AS (SELECT * FROM (VALUES {grid}) v(pair, tm)),
hits AS (SELECT record_id, item, count(*) AS n FROM (SELECT record_id, unnest(items) AS item FROM listed) GROUP BY ALL),
dev AS (SELECT l.source, tm.pair, CASE WHEN len(items) = 0 THEN 0.0 ELSE (coalesce(h.n, 0) / len(items) - tm) / sqrt(tm * (1 - tm) / len(items)) END AS d
  FROM listed l CROSS JOIN tm LEFT JOIN hits h ON h.record_id = l.record_id AND h.item = tm.pair)
SELECT source, 'DDE_' || pair AS feature, {R('avg(d)')} AS mean_deviation FROM dev GROUP BY ALL"""


@query("D16_dde_profile", B.with_sql(B.FRAGS, _dde_sql().lstrip()))
def _(t):
    return RV.dipeptide_deviation_profile(B.fragments(t), ["source"], "seq").withColumn("mean_deviation", S.r6(c("mean_deviation")))


@query("D17_tpc_profile", B.with_sql(B.FRAGS, profile_sql(tri("seq", 0), by="lang").lstrip()))
def _(t):
    return _profile(t, "lang", 3)


@query("D18_gaac", B.with_sql(B.FRAGS, "SELECT record_id, " + ", ".join(
    f'{R(COUNT("seq", m) + " / length(seq)")} AS "GAAC_{k}"' for k, m in D.FIVE_GROUPS.items()) + " FROM frags"))
def _(t):
    return _rounded(B.fragments(t), D.grouped_composition(c("seq")))


def gapped_profile_sql(seq: str, table: str, gaps) -> str:
    """Profile over several gaps: an item carries its gap, and each gap has its own denominator."""
    selects = " UNION ALL ".join(
        f"SELECT grp, item, count(*) AS n, sum(1.0::DOUBLE / size) AS total FROM (SELECT source AS grp, unnest({at(seq, g)}) || '.gap{g}' AS item, "
        f"length({seq}) - {g + 1} AS size FROM {table}) GROUP BY ALL" for g in gaps)
    return f""", profile AS ({selects}), n_rows AS (SELECT source AS grp, count(*) AS n_rec FROM {table} GROUP BY 1)
SELECT grp AS source, item AS feature, n AS n_occurrences, {R('total / n_rec')} AS mean_frequency FROM profile JOIN n_rows USING (grp)"""


GAPS = (0, 1, 2, 3)


def _gapped(t, groups=None):
    out = RV.tuple_profile(B.fragments(t), ["source"], "seq", [(2, g, f".gap{g}") for g in GAPS], groups)
    return out.withColumn("mean_frequency", S.r6(c("mean_frequency")))


@query("D20_cksaap_profile", B.with_sql(B.FRAGS, gapped_profile_sql("seq", "frags", GAPS).lstrip()))
def _(t):
    return _gapped(t)


@query("D21_cksaagp_profile", B.with_sql(B.FRAGS + coded(D.FIVE_GROUPS), gapped_profile_sql("z", "coded", GAPS).lstrip()))
def _(t):
    return _gapped(t, D.FIVE_GROUPS)


@query("D22_gdpc_profile", B.with_sql(B.FRAGS + coded(D.FIVE_GROUPS), profile_sql(at("z", 0), "coded").lstrip()))
def _(t):
    return _profile(t, "source", 2, 0, D.FIVE_GROUPS)


@query("D23_gtpc_profile", B.with_sql(B.FRAGS + coded(D.FIVE_GROUPS), profile_sql(tri("z", 0), "coded").lstrip()))
def _(t):
    return _profile(t, "source", 3, 0, D.FIVE_GROUPS)


ASDC = ("flatten(list_transform(range(1, length(sequence)), lambda i: list_transform(range(i + 1, length(sequence) + 1), "
        "lambda j: substr(sequence, i, 1) || substr(sequence, j, 1))))")


@query("D24_asdc_profile", B.with_sql(B.EVERY, """
, letters AS MATERIALIZED (SELECT source_db, record_id, length, i, substr(sequence, i, 1) AS b FROM (SELECT *, unnest(range(1, length + 1)) AS i FROM records)),
runs AS (SELECT x.source_db, x.record_id, x.length, x.b, a, sum(CASE WHEN x.b = a THEN 1 ELSE 0 END) OVER (PARTITION BY x.record_id, a ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
  FROM letters x, (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS a)),
pairs AS (SELECT source_db, record_id, a || b AS item, sum(n) AS n, any_value(length) AS length FROM runs WHERE n > 0 GROUP BY ALL),
n_rows AS (SELECT source_db, count(*) AS n_rec FROM records GROUP BY 1)
SELECT source_db, item AS feature, CAST(sum(n) AS BIGINT) AS n_occurrences, """.lstrip() + R("sum(n / (length * (length - 1) / 2.0)) / any_value(n_rec)") + """ AS mean_frequency
FROM pairs JOIN n_rows USING (source_db) GROUP BY ALL"""))
def _(t):
    return OC.skip_pair_profile(B.every_record(t), "source_db", "sequence").withColumn("mean_frequency", S.r6(c("mean_frequency")))


# A supplied 10-letter residue clustering; any other mapping works the same way.
CLUSTERS_10 = {"A": "A", "C": "C", "G": "G", "P": "P", "I": "ILMV", "F": "FYW", "S": "ST", "N": "NQ", "D": "DE", "K": "HKR"}


@query("D25_distance_pairs", B.with_sql(B.FRAGS + coded(CLUSTERS_10), f"""
, rec AS (SELECT source AS grp, count(*) AS n_rec FROM coded GROUP BY 1),
profile AS (SELECT grp, item, count(*) AS n, sum(1.0::DOUBLE / size) AS total FROM (SELECT source AS grp, unnest(string_split(z, '')) AS item, length(z) AS size FROM coded) GROUP BY ALL
  UNION ALL SELECT grp, item, count(*), sum(1.0::DOUBLE / size) FROM (SELECT source AS grp, unnest({at('z', 0)}) || '.d1' AS item, length(z) - 1 AS size FROM coded) GROUP BY ALL
  UNION ALL SELECT grp, item, count(*), sum(1.0::DOUBLE / size) FROM (SELECT source AS grp, unnest({at('z', 1)}) || '.d2' AS item, length(z) - 2 AS size FROM coded) GROUP BY ALL)
SELECT grp AS source, 'DP_' || item AS feature, n AS n_occurrences, {R('total / n_rec')} AS mean_frequency FROM profile JOIN rec USING (grp)""".lstrip()))
def _(t):
    kinds = [(1, 0, ""), (2, 0, ".d1"), (2, 1, ".d2")]
    return RV.tuple_profile(B.fragments(t), ["source"], "seq", kinds, CLUSTERS_10, "DP_").withColumn("mean_frequency", S.r6(c("mean_frequency")))


# --- autocorrelation and order ---------------------------------------------------------------------------------

SCALES = {"kd": D.KD, "boman": D.BOMAN}
LAGS = (1, 2, 3)


def lag_table(scales: dict, lags) -> str:
    """Residue values per position with their lagged partners and the record means."""
    vals = ", ".join(f"{case_sql(D.standardised(s))} AS {n}" for n, s in scales.items())
    lead = ", ".join(f"lead({n}, {k}) OVER w AS {n}_{k}" for n in scales for k in lags)
    means = ", ".join(f"avg({n}) OVER (PARTITION BY record_id) AS m_{n}" for n in scales)
    return f""", pos AS (SELECT record_id, i, length AS size, substr(sequence, i, 1) AS c FROM (SELECT record_id, sequence, length, unnest(range(1, length + 1)) AS i FROM records)),
v AS (SELECT record_id, i, size, {vals} FROM pos),
lagged AS MATERIALIZED (SELECT *, {lead}, {means} FROM v WINDOW w AS (PARTITION BY record_id ORDER BY i))"""


def _auto_sql() -> str:
    out = []
    for n in SCALES:
        for k in LAGS:
            spread = f"sum(({n} - m_{n}) * ({n} - m_{n}))"
            out.append(f"{R(f'sum(({n} - m_{n}) * ({n}_{k} - m_{n})) / (max(size) - {k}) / nullif(CASE WHEN {spread} > 1e-12 * max(size) THEN {spread} END / max(size), 0)')} AS \"Moran_{n}_lag{k}\"")
            out.append(f"{R(f'sum(({n} - {n}_{k}) * ({n} - {n}_{k})) / (2.0 * (max(size) - {k})) / nullif(CASE WHEN {spread} > 1e-12 * (max(size) - 1) THEN {spread} END / (max(size) - 1), 0)')} AS \"Geary_{n}_lag{k}\"")
            out.append(f"{R(f'sum({n} * {n}_{k}) / (max(size) - {k})')} AS \"NMBroto_{n}_lag{k}\"")
    inner = f"SELECT record_id, {', '.join(out)} FROM lagged GROUP BY 1"
    names = [f"{kind}_{n}_lag{k}" for n in SCALES for k in LAGS for kind in ("Moran", "Geary", "NMBroto")]
    cols = ", ".join('coalesce("{0}", 0.0) AS "{0}"'.format(x) for x in names)
    return f", a AS ({inner}) SELECT record_id, {cols} FROM a"


@query("D26_autocorrelation", B.with_sql(B.EVERY + lag_table(SCALES, LAGS), _auto_sql().lstrip()))
def _(t):
    df = RV.with_autocorrelation(B.every_record(t).select("record_id", "sequence"), "sequence", SCALES, LAGS)
    names = [n for n in df.columns if n not in ("record_id", "sequence")]
    return df.select("record_id", *[S.r6(c(n)).alias(n) for n in names])


# A supplied distance matrix: absolute difference of two residues on the hydropathy scale.
DISTANCE = {a + b: abs(D.KD[a] - D.KD[b]) for a in RESIDUES for b in RESIDUES}


def _order_sql() -> str:
    tau = ", ".join(f"coalesce(sum(pow(abs(k - k_{d}), 2)), 0.0) AS t{d}" for d in LAGS)
    total = "(1.0 + 0.1::DOUBLE * (t1 + t2 + t3))"
    shares = ", ".join(f'{R(COUNT("sequence", r) + " / length / " + total)} AS "QSO_{r}"' for r in RESIDUES)
    tails = ", ".join(f'{R(f"t{d}")} AS "SOCN_{d}", {R(f"0.1::DOUBLE * t{d} / " + total)} AS "QSO_lag{d}"' for d in LAGS)
    lead = ", ".join(f"lead(k, {d}) OVER (PARTITION BY record_id ORDER BY i) AS k_{d}" for d in LAGS)
    return f""", v AS (SELECT record_id, i, {case_sql(D.KD, 'substr(sequence, i, 1)')} AS k FROM (SELECT record_id, sequence, unnest(range(1, length + 1)) AS i FROM records)),
l AS (SELECT *, {lead} FROM v), tau AS (SELECT record_id, {tau} FROM l GROUP BY 1)
SELECT record_id, {shares}, {tails} FROM records JOIN tau USING (record_id)"""


@query("D27_sequence_order", B.with_sql(B.EVERY, _order_sql().lstrip()))
def _(t):
    df = RV.with_quasi_order(B.every_record(t).select("record_id", "sequence"), "sequence", DISTANCE, 3)
    return df.select("record_id", *[S.r6(c(n)).alias(n) for n in df.columns if n.startswith(("SOCN", "QSO"))])


def _cov_sql() -> str:
    out = []
    for a in SCALES:
        for b in SCALES:
            label = f"AC_{a}" if a == b else f"CC_{a}_{b}"
            for k in LAGS:
                out.append(f"coalesce({R(f'sum(({a} - m_{a}) * ({b}_{k} - m_{b})) / nullif(max(size) - {k}, 0)')}, 0.0) AS \"{label}_lag{k}\"")
    return f"SELECT record_id, {', '.join(out)} FROM lagged GROUP BY 1"


@query("D28_covariance", B.with_sql(B.EVERY + lag_table(SCALES, LAGS), _cov_sql()))
def _(t):
    df = RV.with_covariance(B.every_record(t).select("record_id", "sequence"), "sequence", SCALES, LAGS)
    return df.select("record_id", *[S.r6(c(n)).alias(n) for n in df.columns if n.startswith(("AC_", "CC_"))])


def _triad_sql() -> str:
    selects = " UNION ALL ".join(
        f"SELECT record_id, source_db, item, count(*) AS n FROM (SELECT record_id, source_db, unnest({tri('z', g)}) || '.gap{g}' AS item FROM coded) GROUP BY ALL" for g in GAPS)
    return f""", k AS ({selects}), m AS (SELECT *, max(n) OVER (PARTITION BY record_id, substr(item, 4)) AS top FROM k),
rec AS (SELECT source_db, count(*) AS n_rec FROM coded GROUP BY 1)
SELECT m.source_db, item AS feature, {B.r9_sql('sum(n / top) / any_value(n_rec) + 1e-12')} AS mean_share FROM m JOIN rec ON rec.source_db = m.source_db GROUP BY ALL"""


@query("D29_triad_profile", B.with_sql(B.EVERY + coded(D.SEVEN_CLASSES, "records", "sequence", "source_db"), _triad_sql().lstrip()))
def _(t):
    return OC.class_triad_profile(B.every_record(t), "source_db", "sequence", GAPS, D.SEVEN_CLASSES).withColumn("mean_share", S.r9(c("mean_share") + 1e-12))  # the slack settles ties of the rounding


PSEUDO = D.PSEUDO_PROPERTIES
AMPHI = {k: PSEUDO[k] for k in ("Hydrophobicity", "Hydrophilicity")}


def _paac_sql() -> str:
    names = list(PSEUDO)
    theta = ", ".join(
        f"coalesce(sum({' + '.join(f'({n} - {n}_{k}) * ({n} - {n}_{k})' for n in names)}) / {len(names)} / (max(size) - {k}), 0.0) AS t{k}" for k in LAGS)
    total = "(1.0 + 0.05::DOUBLE * (t1 + t2 + t3))"
    return f""", t AS (SELECT record_id, {theta} FROM lagged GROUP BY 1)
SELECT record_id, {', '.join(f'{R(COUNT("sequence", r) + " / " + total)} AS "PAAC_Xc1.{r}"' for r in RESIDUES)},
 {', '.join(f'{R(f"0.05::DOUBLE * t{k} / " + total)} AS "PAAC_Xc2.lambda{k}"' for k in LAGS)} FROM records JOIN t USING (record_id)"""


def _apaac_sql() -> str:
    terms = [(n, k) for k in LAGS for n in AMPHI]
    theta = ", ".join(f"coalesce(sum({n} * {n}_{k}) / (max(size) - {k}), 0.0) AS t_{n}_{k}" for n, k in terms)
    total = f"(1.0 + 0.05::DOUBLE * ({' + '.join(f't_{n}_{k}' for n, k in terms)}))"
    return f""", t AS (SELECT record_id, {theta} FROM lagged GROUP BY 1)
SELECT record_id, {', '.join(f'{R(COUNT("sequence", r) + " / " + total)} AS "APAAC_Pc1.{r}"' for r in RESIDUES)},
 {', '.join(f'{R(f"0.05::DOUBLE * t_{n}_{k} / " + total)} AS "APAAC_Pc2.{n}.{k}"' for n, k in terms)} FROM records JOIN t USING (record_id)"""


def _named(df, prefix):
    return df.select("record_id", *[S.r6(c(f"`{n}`")).alias(n) for n in df.columns if n.startswith(prefix)])


@query("D30_paac", B.with_sql(B.EVERY + lag_table(PSEUDO, LAGS), _paac_sql().lstrip()))
def _(t):
    return _named(RV.with_pseudo_composition(B.every_record(t).select("record_id", "sequence"), "sequence", PSEUDO, 3), "PAAC")


@query("D30_apaac", B.with_sql(B.EVERY + lag_table(AMPHI, LAGS), _apaac_sql().lstrip()))
def _(t):
    return _named(RV.with_amphiphilic_composition(B.every_record(t).select("record_id", "sequence"), "sequence", AMPHI, 3), "APAAC")


@query("D31_reduced_alphabet", B.with_sql(B.FRAGS + coded(CLUSTERS_10), profile_sql(at("z", 1), "coded").lstrip()))
def _(t):
    return _profile(t, "source", 2, 1, CLUSTERS_10)


@query("D33_mean_pool", f"""
SELECT label, dim, {R('avg(x::DOUBLE)')} AS value FROM (SELECT label, unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INT) AS dim FROM embeddings) GROUP BY ALL""")
def _(t):
    return D.mean_vector(t.embeddings, ["label"], "embedding").withColumn("value", S.r6(c("value")))


@query("D33_token_mean_pool", f"""
SELECT vec_id, {R('((embedding[3] + 0.0::DOUBLE) + embedding[5] + embedding[7]) / 3')} AS d0, {R('((embedding[4] + 0.0::DOUBLE) + embedding[6] + embedding[8]) / 3')} AS d1 FROM embeddings""")
def _(t):
    # five two-dimensional tokens per row; the first and the last are the start and end tokens
    tokens = F.array(*[F.slice("embedding", 2 * i + 1, 2) for i in range(5)])
    pooled = t.embeddings.select("vec_id", D.mean_pool(tokens).alias("p"))
    return pooled.select("vec_id", S.r6(F.get("p", F.lit(0))).alias("d0"), S.r6(F.get("p", F.lit(1))).alias("d1"))


# --- feature names -----------------------------------------------------------------------------------------------

# Names are taken from the residues and pairs that occur in the records.
NAMES = B.RECORDS + f""", names AS MATERIALIZED (
  SELECT 'AAC_' || x AS name, min(k) AS pos FROM (SELECT unnest(string_split(sequence, '')) AS x, doc_id * 1000000 + frag_no AS k FROM records) GROUP BY 1
  UNION ALL SELECT 'DDE_' || x, min(k) FROM (SELECT unnest({at('sequence', 0)}) AS x, doc_id * 1000000 + frag_no AS k FROM records) GROUP BY 1
  UNION ALL SELECT 'CKSAAP_' || x || '.gap1', min(k) FROM (SELECT unnest({at('sequence', 1)}) AS x, doc_id * 1000000 + frag_no AS k FROM records) GROUP BY 1)"""


def _names(t):
    r = B.records(t).select((c("doc_id") * 1000000 + c("frag_no")).alias("k"), D.chars(c("sequence")).alias("x"))
    parts = (("AAC_", c("x"), ""), ("DDE_", D.pairs(c("x")), ""), ("CKSAAP_", D.pairs(c("x"), 1), ".gap1"))
    out = None
    for tag, items, tail in parts:
        named = r.select("k", F.explode(items).alias("i")).groupBy(F.concat(F.lit(tag), "i", F.lit(tail)).alias("name")).agg(F.min("k").alias("pos"))
        out = named if out is None else out.unionByName(named)
    return out


@query("P13_feature_groups", B.with_sql(NAMES, "SELECT split_part(name, '_', 1) AS feature_group, count(*) AS n_features, min(pos) AS first_position FROM names GROUP BY 1"))
def _(t):
    return FE.feature_groups(_names(t), "name", "pos")


def _label_sql() -> str:
    long = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FE.RESIDUE_LABELS.items()) + " ELSE {0} END"
    pair = "split_part(split_part(name, '_', 2), '.', 1)"
    first, second = long.format(f"substr({pair}, 1, 1)"), long.format(f"substr({pair}, 2, 1)")
    return f"""SELECT name, CASE WHEN name LIKE 'AAC\\_%' ESCAPE '\\' THEN 'AAC: ' || {long.format("split_part(name, '_', 2)")} || ' frequency'
  WHEN name LIKE 'DDE\\_%' ESCAPE '\\' THEN 'DDE: ' || {first} || '-' || {second} || ' deviation'
  ELSE 'CKSAAP: ' || {first} || '-' || {second} || ' (gap 1)' END AS label,
  replace(replace(replace(name, 'CKSAAP_', 'CK:'), 'DDE_', 'DDE:'), 'AAC_', 'AAC:') AS abbreviation, contains({pair}, 'C') AS about_c FROM names"""


@query("P21_feature_labels", B.with_sql(NAMES, _label_sql()))
def _(t):
    n = c("name")
    return _names(t).select("name", FE.feature_label(n).alias("label"), FE.abbreviation(n).alias("abbreviation"), FE.about_residue(n, "C").alias("about_c"))
