"""Candidate scoring, ranking, shortlists and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import composition as Q, scalars as S
from ..operators import curation as C, ranking as RK, screening as SC
from . import base as B
from .descriptor_queries import QC_SQL
from .registry import query

c = F.col
R = B.r6_sql
MIN_A, MAX_B = 0.7, 0.3

SCORED = B.CAND + f""",
dec AS MATERIALIZED (SELECT *, 1.0 / (1.0 + exp(-((score_a - {MIN_A}::DOUBLE) / 0.08::DOUBLE))) AS desirability,
  1.0 / (1.0 + exp(-(({MAX_B}::DOUBLE - score_b) / 0.08::DOUBLE))) AS safety,
  qc_pass::INT::DOUBLE * (1.0 - low_complexity::INT * 0.8::DOUBLE) * (1.0 - homopolymer::INT * 0.7::DOUBLE) * (1.0 - gf_rich::INT * 0.6::DOUBLE) AS quality FROM cand),
scored AS MATERIALIZED (SELECT *, pow((desirability + 1e-9) * (safety + 1e-9) * (quality + 1e-9), 1.0 / 3.0) AS raw_decision FROM dec),
ranked AS MATERIALIZED (SELECT *, {R('raw_decision')} AS decision_score, row_number() OVER (ORDER BY {R('raw_decision')} DESC, qc_pass DESC, cand_id) AS rank FROM scored)"""


def _scored(t):
    return SC.decision_columns(B.candidates(t), "score_a", "score_b", MIN_A, MAX_B)


def _ranked(t):
    # the score is rounded first: a rank must not hang on the last bit of a power function
    return SC.rank_candidates(_scored(t).withColumn("decision_score", S.r6(c("decision_score"))), "cand_id")


def rounded(df, keys, values):
    return df.select(*keys, *[S.r6(c(v)).alias(v) for v in values])


@query("P15_desirability", B.with_sql(SCORED, f"SELECT cand_id, {R('desirability')} AS desirability, {R('safety')} AS safety FROM scored"))
def _(t):
    return rounded(_scored(t), ["cand_id"], ["desirability", "safety"])


@query("P16_quality", B.with_sql(SCORED, f"SELECT cand_id, {R('quality')} AS quality FROM scored"))
def _(t):
    return rounded(_scored(t), ["cand_id"], ["quality"])


@query("P17_decision_score", B.with_sql(SCORED, f"SELECT cand_id, {R('raw_decision')} AS decision_score FROM scored"))
def _(t):
    return rounded(_scored(t), ["cand_id"], ["decision_score"])


CLIP = "least(greatest({0}, 0.0), 1.0)"


@query("P18_joint_score", B.with_sql(B.CAND, f"""
SELECT cand_id, {R(f"sqrt({CLIP.format('score_a')} * {CLIP.format('1.0 - score_b')})")} AS joint, {R(f"sqrt({CLIP.format('score_a')} * (1.0 - {CLIP.format('score_b')}))")} AS priority FROM cand"""))
def _(t):
    return B.candidates(t).select("cand_id", S.r6(S.joint_score(c("score_a"), c("score_b"))).alias("joint"), S.r6(S.priority_score(c("score_a"), c("score_b"))).alias("priority"))


TIER_SQL = ", ".join(f"qc_pass AND score_a >= {lo} AND score_b <= {hi} AS {n}" for n, lo, hi in S.TIERS)
TIER_NAMES = [n for n, _, _ in S.TIERS]


@query("P19_tier_flags", B.with_sql(B.CAND, f"SELECT cand_id, {TIER_SQL} FROM cand"))
def _(t):
    return SC.tier_columns(B.candidates(t), "score_a", "score_b").select("cand_id", *TIER_NAMES)


PRACTICAL = QC_SQL + """, tiered AS (SELECT *, CASE WHEN length BETWEEN 12 AND 35 AND NOT contains_c AND NOT m_start THEN 1 WHEN length BETWEEN 10 AND 40 AND NOT contains_c THEN 2 ELSE 3 END AS tier FROM qc),
lim AS (SELECT CASE WHEN count(*) FILTER (tier = 1) >= 50 THEN 1 WHEN count(*) FILTER (tier <= 2) >= 50 THEN 2 ELSE 3 END AS lim FROM tiered)"""


@query("P23_practical_candidates", B.with_sql(PRACTICAL, "SELECT record_id, length FROM tiered, lim WHERE tier <= lim"))
def _(t):
    s = c("seq")
    df = B.fragments(t).select("record_id", F.length(s).cast("long").alias("length"), F.contains(s, F.lit("C")).alias("contains_c"), F.startswith(s, F.lit("M")).alias("m_start"))
    return SC.practical_candidates(df).select("record_id", "length")


# --- ranks ------------------------------------------------------------------------------------------

@query("W02_global_rank", B.with_sql(SCORED, "SELECT cand_id, rank, decision_score FROM ranked"))
def _(t):
    return _ranked(t).select("cand_id", "rank", "decision_score")


PRIORITY = B.CAND + f""", pr AS MATERIALIZED (SELECT *, sqrt({CLIP.format('score_a')} * (1.0 - {CLIP.format('score_b')})) AS priority FROM cand),
pranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY qc_pass DESC, priority DESC, score_a DESC, score_b, len, cand_id) AS rank_all FROM pr)"""


@query("W03_priority_ranks", B.with_sql(PRIORITY, "SELECT cand_id, rank_all, CASE WHEN qc_pass THEN rank_all ELSE 0 END AS rank_qc FROM pranked"))
def _(t):
    out = SC.priority_ranked(B.candidates(t), "score_a", "score_b", "len", "cand_id")
    return out.select("cand_id", "rank_all", F.coalesce("rank_qc", F.lit(0).cast("long")).alias("rank_qc"))


@query("W04_importance_rank", "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(c("p_retailprice").desc(), "p_partkey")
    return t.part.select("p_partkey", "p_brand", F.row_number().over(w).cast("long").alias("rank"))


@query("W05_share_of_maximum", f"SELECT p_partkey, {R('100 * p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand)')} AS share FROM part")
def _(t):
    best = t.part.groupBy("p_brand").agg(F.max("p_retailprice").alias("top"))  # combines map-side, unlike a window
    return t.part.join(best, "p_brand").select("p_partkey", S.r6(100 * c("p_retailprice") / c("top")).alias("share"))


LEAD = "'lead'"
PCTS = (1.0, 5.0, 10.0, 20.0)
# The lead candidate is the one with the largest id text among QC-passing rows of a tier, found in the data.
SCOPE = SCORED + """, lead AS (SELECT max(cand_id) AS id FROM scored WHERE qc_pass AND score_a >= 0.9 AND score_b <= 0.1),
base AS (SELECT count(*) AS n, max(CASE WHEN cand_id = id THEN rank END) AS lead_rank FROM ranked, lead),
bins AS (SELECT pct, greatest(1, CAST(ceil(n * pct / 100.0) AS BIGINT)) AS cutoff FROM base, (SELECT unnest([1.0, 5.0, 10.0, 20.0])::DOUBLE AS pct)),
scope AS (SELECT n, lead_rank, 100.0 * lead_rank / n AS lead_percentile, coalesce((SELECT min(pct) FROM bins WHERE lead_rank <= cutoff), 100.0::DOUBLE * lead_rank / n) AS pct,
  coalesce((SELECT min(cutoff) FROM bins WHERE lead_rank <= cutoff), lead_rank) AS cutoff FROM base)"""


def _lead(t) -> str:
    strong = B.candidates(t).where("qc_pass AND score_a >= 0.9 AND score_b <= 0.1")
    return strong.agg(F.max("cand_id")).first()[0]  # one id


@query("W06_lead_scope", B.with_sql(SCOPE, f"SELECT n, lead_rank, {R('lead_percentile')} AS lead_percentile, {R('pct')} AS pct, cutoff FROM scope"))
def _(t):
    return rounded(SC.lead_scope(_ranked(t), _lead(t), PCTS, "cand_id"), ["n", "lead_rank", "cutoff"], ["lead_percentile", "pct"])


@query("W07_top_per_group", "SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 12")
def _(t):
    out = RK.top_per_group(t.part, ["p_brand"], [c("p_retailprice").desc(), c("p_partkey").asc()], 12)
    return out.select("p_brand", "p_partkey", c("rank").cast("long").alias("rank"))


# --- sorts, top-k and shortlists -------------------------------------------------------------------------

@query("T01_multi_key_sort", B.with_sql(B.CAND, "SELECT cand_id, score_b, score_m, len FROM cand ORDER BY score_b DESC, score_m ASC, len DESC, cand_id"))
def _(t):
    return B.candidates(t).select("cand_id", "score_b", "score_m", "len").orderBy(c("score_b").desc(), c("score_m").asc(), c("len").desc(), "cand_id")


@query("T02_top_n", B.with_sql(SCORED, "SELECT rank, cand_id, decision_score, qc_pass FROM ranked WHERE rank <= 50"))
def _(t):
    order = [c("decision_score").desc(), c("qc_pass").desc(), c("cand_id").asc()]
    top = _scored(t).withColumn("decision_score", S.r6(c("decision_score"))).orderBy(*order).limit(50)
    return RK.global_position(top, order, "rank").select("rank", "cand_id", "decision_score", "qc_pass")


@query("T03_threshold_shortlist", B.with_sql(SCORED, "SELECT cand_id, 'threshold_rule' AS shortlist_scope FROM ranked WHERE qc_pass AND score_a >= 0.7 AND score_b <= 0.3 AND decision_score >= 0.5"))
def _(t):
    df = _scored(t).withColumn("decision_score", S.r6(c("decision_score")))
    return SC.threshold_shortlist(df, "score_a", "score_b", MIN_A, MAX_B, 0.5).select("cand_id", "shortlist_scope")


@query("T04_adaptive_shortlist", B.with_sql(SCOPE, "SELECT cand_id, rank FROM ranked, scope WHERE rank <= cutoff"))
def _(t):
    return SC.adaptive_shortlist(_ranked(t), _lead(t), PCTS, "cand_id").select("cand_id", "rank")


RELAX = SCORED + """, st AS (SELECT *, CASE WHEN len BETWEEN 12 AND 35 AND NOT gf_rich AND NOT homopolymer THEN 1 WHEN len BETWEEN 10 AND 40 AND NOT gf_rich THEN 2 ELSE 3 END AS tier
  FROM (SELECT * REPLACE (len * 7 AS len) FROM ranked) WHERE qc_pass AND score_a >= 0.9 AND score_b <= 0.1),
lim AS (SELECT CASE WHEN count(*) FILTER (tier = 1) >= 50 THEN 1 WHEN count(*) FILTER (tier <= 2) >= 50 THEN 2 ELSE 3 END AS lim FROM st)"""


@query("T05_relaxed_top", B.with_sql(RELAX, "SELECT cand_id, decision_score FROM st, lim WHERE tier <= lim ORDER BY decision_score DESC, score_a DESC, score_b, len, cand_id LIMIT 50"))
def _(t):
    df = _scored(t).withColumn("decision_score", S.r6(c("decision_score"))).select("*", (c("len") * 7).alias("length"), c("gf_rich").alias("contains_c"), c("homopolymer").alias("m_start"))
    _, lo, hi = S.TIERS[1]
    strict = df.where(S.tier_flag(c("qc_pass"), c("score_a"), c("score_b"), lo, hi))
    return SC.relaxed_top(strict, 50, "score_a", "score_b", "cand_id").select("cand_id", "decision_score")


@query("U06_validation_set", B.with_sql(SCOPE, """
SELECT cand_id, CASE WHEN qc_pass AND score_a >= 0.9 AND score_b <= 0.1 AND cand_id = id THEN 'model_pass_and_prior_lead'
  WHEN qc_pass AND score_a >= 0.9 AND score_b <= 0.1 THEN 'model_stringent_threshold_pass' ELSE 'prior_lead_reference_flagged' END AS selection_route
FROM scored, lead WHERE (qc_pass AND score_a >= 0.9 AND score_b <= 0.1) OR cand_id = id"""))
def _(t):
    return SC.validation_set(_scored(t), _lead(t), "score_a", "score_b", "cand_id").select("cand_id", "selection_route")


@query("J10_background", B.with_sql(SCORED, "SELECT cand_id FROM ranked WHERE NOT (qc_pass AND score_a >= 0.7 AND score_b <= 0.3 AND decision_score >= 0.5)"))
def _(t):
    df = _scored(t).withColumn("decision_score", S.r6(c("decision_score")))
    short = SC.threshold_shortlist(df, "score_a", "score_b", MIN_A, MAX_B, 0.5)
    return df.join(short, "cand_id", "left_anti").select("cand_id")


# --- report tables -----------------------------------------------------------------------------------------

POINTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)
QUANTS = ("score_a", "score_b", "score_m", "decision_score", "quality")


@query("A18_quantile_table", B.with_sql(SCORED, " UNION ALL ".join(
    f"SELECT '{k}' AS metric, {p}::DOUBLE AS quantile, {R(f'quantile_cont({k}, {p})')} AS value FROM (SELECT *, decision_score AS d FROM ranked)" for k in QUANTS for p in POINTS)))
def _(t):
    df = _scored(t).withColumn("decision_score", S.r6(c("decision_score")))
    return rounded(SC.quantile_table(df, QUANTS, POINTS), ["metric", "quantile"], ["value"])


QC_RATES = ("qc_pass", "low_complexity", "homopolymer", "gf_rich")
_SUMMARY_COLS = f"count(*) AS n, {R('avg(score_a)')} AS mean_a, {R('avg(score_b)')} AS mean_b, {R('avg(decision_score)')} AS mean_decision, " + ", ".join(f"{R(f'avg({k}::INT)')} AS {k}_rate" for k in QC_RATES)


@query("A19_qc_summary", B.with_sql(SCORED, f"""
SELECT 'all_candidates' AS "set", {_SUMMARY_COLS} FROM ranked UNION ALL SELECT 'shortlist', {_SUMMARY_COLS} FROM ranked WHERE qc_pass AND score_a >= 0.7
UNION ALL SELECT 'source:' || pool, {_SUMMARY_COLS} FROM ranked GROUP BY pool"""))
def _(t):
    out = SC.qc_summary(_scored(t).withColumn("decision_score", S.r6(c("decision_score"))), c("qc_pass") & (c("score_a") >= 0.7), "pool", "score_a", "score_b")
    return rounded(out, ["set", "n"], ["mean_a", "mean_b", "mean_decision"] + [f"{k}_rate" for k in QC_RATES])


def _pool_sql() -> str:
    tiers = ", ".join(f"count(*) FILTER (qc_pass AND score_a >= {lo} AND score_b <= {hi}) AS {n}_n, {R(f'avg((qc_pass AND score_a >= {lo} AND score_b <= {hi})::INT)')} AS {n}_rate" for n, lo, hi in S.TIERS)
    stats = ", ".join(f"{R(f'avg({k})')} AS mean_{n}, {R(f'median({k})')} AS median_{n}" for n, k in (("a", "score_a"), ("b", "score_b"), ("decision", "decision_score")))
    return f"""SELECT pool, count(*) AS n, count(*) FILTER (qc_pass) AS qc_pass_n, {R('avg(qc_pass::INT)')} AS qc_pass_rate, count(*) FILTER (score_a >= 0.7) AS a_ge_0p70_n,
 {R('avg((score_a >= 0.7)::INT)')} AS a_ge_0p70_rate, count(*) FILTER (score_b <= 0.3) AS b_le_0p30_n, {R('avg((score_b <= 0.3)::INT)')} AS b_le_0p30_rate, {stats}, {tiers} FROM ranked GROUP BY pool"""


@query("A20_pool_summary", B.with_sql(SCORED, _pool_sql()))
def _(t):
    out = SC.pool_summary(_scored(t).withColumn("decision_score", S.r6(c("decision_score"))), "pool", "score_a", "score_b")
    counts = ["pool", "n"] + [k for k in out.columns if k.endswith("_n")]
    return rounded(out, counts, [k for k in out.columns if k not in counts])


def _tier_sql() -> str:
    rows = []
    for n, lo, hi in S.TIERS:
        f = f"qc_pass AND score_a >= {lo} AND score_b <= {hi}"
        a, b, na, nb = (f"count(*) FILTER (pool = 'A' AND {f})", f"count(*) FILTER (pool = 'N' AND {f})", "count(*) FILTER (pool = 'A')", "count(*) FILTER (pool = 'N')")
        rows.append(f"SELECT '{n}' AS tier, {a} AS base_n, {na} AS base_total, {b} AS treated_n, {nb} AS treated_total, {R(f'{a} / {na}')} AS base_rate, {R(f'{b} / {nb}')} AS treated_rate, "
                    f"{R(f'{b} / {nb} - {a} / {na}')} AS rate_delta, CASE WHEN {a} > 0 THEN {R(f'({b} / {nb}) / ({a} / {na})')} ELSE 'Infinity'::DOUBLE END AS fold_enrichment FROM cand")
    return " UNION ALL ".join(rows)


@query("A21_tier_enrichment", B.with_sql(B.CAND, _tier_sql()))
def _(t):
    cand = B.candidates(t)
    out = SC.tier_enrichment(cand.where("pool = 'A'"), cand.where("pool = 'N'"), "score_a", "score_b")
    return rounded(out, ["tier", "base_n", "base_total", "treated_n", "treated_total"], ["base_rate", "treated_rate", "rate_delta"]).join(
        out.select("tier", F.when(F.col("fold_enrichment") == float("inf"), c("fold_enrichment")).otherwise(S.r6(c("fold_enrichment"))).alias("fold_enrichment")), "tier")


AUDIT_MEANS = ("length", "c_fraction", "entropy_norm", "gly_phe_fraction", "basic_fraction", "aromatic_fraction")
AUDIT_FLAGS = ("m_start", "contains_c", "homopolymer", "gf_rich")


@query("A22_group_audit", B.with_sql(QC_SQL, f"""
SELECT source, count(*) AS n, {R('count(DISTINCT seq) / count(*)')} AS unique_rate, {', '.join(f'{R(f"avg({k})")} AS mean_{k}' for k in AUDIT_MEANS)},
 {', '.join(f'{R(f"avg({k}::INT)")} AS {k}_rate' for k in AUDIT_FLAGS)}, {R('avg((top1_fraction >= 0.35 OR top2_fraction >= 0.60 OR entropy_norm <= 0.55)::INT)')} AS low_complexity_rate,
 {R('avg((doc_id % 10 >= 9)::INT)')} AS oracle_ge_0_9_rate FROM qc GROUP BY 1"""))
def _(t):
    from ..operators.audit import group_audit

    df = Q.with_qc(B.fragments(t), "seq", Q.AUDIT_ENTROPY_LIMIT).withColumn("oracle", (c("doc_id") % 10) / 10)
    out = group_audit(df, "source", "seq", "oracle", AUDIT_MEANS, AUDIT_FLAGS + ("low_complexity",))
    return rounded(out, ["source", "n"], [k for k in out.columns if k not in ("source", "n")])


@query("A23_uniqueness", f"SELECT source, {R('count(DISTINCT text) / count(*)')} AS uniqueness, {R('avg(n_chars)')} AS mean_score FROM documents GROUP BY 1")
def _(t):
    from ..operators.audit import uniqueness

    return rounded(uniqueness(t.documents, "source", "text", "n_chars"), ["source"], ["uniqueness", "mean_score"])


# --- composite jobs ----------------------------------------------------------------------------------------

SCREEN = QC_SQL + f""", sc AS (SELECT l_partkey AS doc_id, avg(l_quantity) / 50 AS score_a, avg(l_discount) * 10 AS score_b FROM lineitem GROUP BY 1),
j AS (SELECT qc.*, sc.score_a, sc.score_b FROM qc LEFT JOIN sc ON sc.doc_id = qc.doc_id),
d AS (SELECT *, {R('''pow((1.0 / (1.0 + exp(-((score_a - 0.5) / 0.08))) + 1e-9) * (1.0 / (1.0 + exp(-((0.5 - score_b) / 0.08))) + 1e-9) *
  (qc_pass::INT * (1.0 - low_complexity::INT * 0.8) * (1.0 - homopolymer::INT * 0.7) * (1.0 - gf_rich::INT * 0.6) + 1e-9)::DOUBLE, 1.0 / 3.0)''')} AS decision_score FROM j)"""


@query("Y08_screening", B.with_sql(SCREEN, "SELECT record_id, decision_score, qc_pass, row_number() OVER (ORDER BY decision_score DESC, qc_pass DESC, record_id) AS rank FROM d"))
def _(t):
    from .jobs import screen_candidates

    scores = t.lineitem.groupBy(c("l_partkey").alias("doc_id")).agg((F.avg("l_quantity") / 50).alias("score_a"), (F.avg("l_discount") * 10).alias("score_b"))
    out = screen_candidates(B.fragments(t).select("record_id", "doc_id", "seq"), "seq", scores, "doc_id", "record_id", 0.5, 0.5)
    return out.select("record_id", "decision_score", "qc_pass", "rank")


@query("Y10_simple_priority", B.with_sql(PRIORITY, f"""
SELECT count(*) AS n_total, count(*) FILTER (qc_pass) AS n_qc_pass, {R('min(score_a) FILTER (qc_pass AND rank_all <= 50)')} AS min_a, {R('max(score_b) FILTER (qc_pass AND rank_all <= 50)')} AS max_b,
  {R('min(priority) FILTER (qc_pass AND rank_all <= 50)')} AS min_priority, {R('median(len) FILTER (qc_pass AND rank_all <= 50)')} AS median_length FROM pranked"""))
def _(t):
    from .jobs import priority_summary

    return rounded(priority_summary(B.candidates(t), "score_a", "score_b", "len", "cand_id", 50), ["n_total", "n_qc_pass"], ["min_a", "max_b", "min_priority", "median_length"])
