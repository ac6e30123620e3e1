"""Histograms, distances, length matching, balanced strata, draws and cluster-aware splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import histograms as H, matching as M, ranking, shortcuts as SC
from . import base as B
from .registry import query

c = F.col
R = B.r6_sql
SEED = 42


# --- histograms -------------------------------------------------------------------------------

@query("A04_length_histogram", B.with_sql(B.RECORDS, "SELECT source_split AS lang, CAST(length AS BIGINT) AS length, count(*) AS n FROM records GROUP BY ALL"))
def _(t):
    return H.length_counts(B.records(t).withColumnRenamed("source_split", "lang"), "lang")


PAIR = B.RECORDS + """,
counts AS (SELECT length, count(*) FILTER (source_split = 'en') AS n_p, count(*) FILTER (source_split = 'de') AS n_q FROM records GROUP BY 1),
filled AS (SELECT s.length, coalesce(n_p, 0) AS n_p, coalesce(n_q, 0) AS n_q FROM (SELECT unnest(range(10, 51)) AS length) s LEFT JOIN counts c ON s.length = c.length),
hist AS MATERIALIZED (SELECT length, n_p, n_q, n_p / sum(n_p) OVER () AS p, n_q / sum(n_q) OVER () AS q FROM filled)"""


def _pair(t):
    return H.paired_histogram(B.records(t), c("source_split") == "en", c("source_split") == "de")


@query("A05_probabilities", B.with_sql(PAIR, f"SELECT length, n_p, n_q, {R('p')} AS p, {R('q')} AS q FROM hist"))
def _(t):
    return _pair(t).select("length", "n_p", "n_q", S.r6(c("p")).alias("p"), S.r6(c("q")).alias("q"))


@query("A06_total_variation", B.with_sql(PAIR, f"SELECT {R('sum(abs(p - q)) / 2')} AS tv FROM hist"))
def _(t):
    return _pair(t).agg(S.r6(H.total_variation(c("p"), c("q"))).alias("tv"))


@query("A07_js_divergence", B.with_sql(PAIR, f"""
SELECT {R("(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2")} AS js FROM hist"""))
def _(t):
    return _pair(t).agg(S.r6(H.js_divergence(c("p"), c("q"))).alias("js"))


@query("A08_js_distance", B.with_sql(PAIR, f"""
SELECT {R("sqrt((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2)")} AS js FROM hist"""))
def _(t):
    return _pair(t).agg(S.r6(H.js_distance(c("p"), c("q"))).alias("js"))


@query("A09_mean_length", B.with_sql(B.RECORDS, f"SELECT source_db, {R('avg(length)')} AS mean_length FROM records GROUP BY 1"))
def _(t):
    return H.mean_length(B.records(t), "source_db").select("source_db", S.r6(c("mean_length")).alias("mean_length"))


LABEL_COUNTS = B.UNIQ_B + """,
hist AS MATERIALIZED (SELECT CAST(length AS BIGINT) AS length, count(*) FILTER (label = 'positive') AS n_p, count(*) FILTER (label = 'negative') AS n_q FROM uniq GROUP BY 1),
cap AS (SELECT CAST(floor(min(n_q / (n_p / tot))) AS BIGINT) AS capacity FROM (SELECT *, sum(n_p) OVER () AS tot FROM hist) WHERE n_p > 0)"""


@query("A11_exact_capacity", B.with_sql(LABEL_COUNTS, "SELECT capacity FROM cap"))
def _(t):
    u = B.unique_rows(t, "toxic")
    return H.exact_capacity(H.paired_histogram(u, c("label") == "positive", c("label") == "negative"))


@query("X03_largest_remainder", B.with_sql(B.RECORDS, """
, h AS (SELECT length, count(*) AS n FROM records GROUP BY 1), s AS (SELECT length, n / sum(n) OVER () AS p FROM h),
f AS (SELECT *, p * 1000 AS raw, floor(p * 1000) AS fl FROM s),
g AS (SELECT *, row_number() OVER (ORDER BY raw - fl DESC, p DESC, length) AS i, 1000 - sum(fl) OVER () AS remainder FROM f)
SELECT CAST(length AS BIGINT) AS length, CAST(fl + CASE WHEN i <= remainder THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g""".lstrip()))
def _(t):
    return M.largest_remainder(H.length_counts(B.records(t)), F.lit(1000))


# --- draws ----------------------------------------------------------------------------------------

U_SAMPLE = B.u_sql(SEED, "sample", "uid")


@query("X01_weighted_sample", B.with_sql(B.UNIQ, f"""
, w AS (SELECT *, CASE WHEN list_contains(source_dbs, 'src1') AND NOT list_contains(source_dbs, 'src2') THEN 3.0
   WHEN list_contains(source_dbs, 'src1') THEN 2.5 WHEN list_contains(source_dbs, 'src2') AND len(source_dbs) = 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS w FROM uniq),
r AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY 1.0 - pow({U_SAMPLE}, 1.0 / w), uid) AS rn FROM w)
SELECT uid, CAST(length AS BIGINT) AS length FROM r WHERE rn <= 10""".lstrip()))
def _(t):
    u = B.unique_rows(t)
    weight = S.source_weight(c("source_dbs"), "src1", "src2")
    quotas = H.support(u).withColumn("quota", F.lit(10))
    drawn = ranking.draw_by_quota(u, ["length"], quotas, M.weighted_order(SEED, "sample", c("uid"), weight), ["uid"])
    return drawn.select("uid", "length")


@query("X02_source_weight", B.with_sql(B.UNIQ, """
SELECT CASE WHEN list_contains(source_dbs, 'src1') AND NOT list_contains(source_dbs, 'src2') THEN 3.0
   WHEN list_contains(source_dbs, 'src1') THEN 2.5 WHEN list_contains(source_dbs, 'src2') AND len(source_dbs) = 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS weight, count(*) AS n
FROM uniq GROUP BY 1"""))
def _(t):
    return B.unique_rows(t).groupBy(S.source_weight(c("source_dbs"), "src1", "src2").alias("weight")).agg(F.count("*").alias("n"))


@query("X06_quota_draw", B.with_sql(B.UNIQ, f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY length ORDER BY {B.u_sql(SEED, 'quota', 'uid')}, uid) AS rn,
        count(*) OVER (PARTITION BY length) AS pool FROM uniq)
SELECT uid, CAST(length AS BIGINT) AS length FROM r WHERE rn <= floor(pool / 3)""".lstrip()))
def _(t):
    u = B.unique_rows(t)
    quotas = u.groupBy("length").agg(F.floor(F.count("*") / 3).alias("quota"))
    return M.quota_draw(u, quotas, SEED, "quota", "uid").select("uid", "length")


EXACT = LABEL_COUNTS + f""",
raw AS (SELECT h.length, n_p / sum(n_p) OVER () AS p, n_q AS room, n_p / sum(n_p) OVER () * capacity AS want FROM hist h, cap WHERE n_p > 0),
base AS (SELECT *, least(floor(want), room) AS have, want - floor(want) AS frac FROM raw),
ordered AS (SELECT *, row_number() OVER (PARTITION BY have < room ORDER BY frac DESC, p DESC, room - have DESC, length DESC) AS i,
            (SELECT capacity FROM cap) - sum(have) OVER () AS left_over FROM base),
quota AS (SELECT length, CAST(have + CASE WHEN have < room AND i <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM ordered),
w AS (SELECT *, CASE WHEN list_contains(source_dbs, 'src1') AND NOT list_contains(source_dbs, 'src2') THEN 3.0
   WHEN list_contains(source_dbs, 'src1') THEN 2.5 WHEN list_contains(source_dbs, 'src2') AND len(source_dbs) = 1 THEN 1.0 ELSE 1.5 END::DOUBLE AS weight FROM uniq WHERE label = 'negative'),
drawn AS (SELECT w.*, row_number() OVER (PARTITION BY w.length ORDER BY 1.0 - pow({B.u_sql(SEED, 'exact', 'uid')}, 1.0 / weight), uid) AS rn, quota
          FROM w JOIN quota ON w.length = quota.length)"""


@query("X07_exact_length_match", B.with_sql(EXACT, """
SELECT uid, label, CAST(length AS BIGINT) AS length FROM uniq WHERE label = 'positive'
UNION ALL SELECT uid, label, CAST(length AS BIGINT) FROM drawn WHERE rn <= quota"""))
def _(t):
    u = B.unique_rows(t, "toxic")
    return M.length_matched_exact(u, SEED, "uid", S.source_weight(c("source_dbs"), "src1", "src2")).select("uid", "label", "length")


# Serving the quotas is sequential: walk over (target, donor) pairs in order and move what is short.
LIBRARY = LABEL_COUNTS + f""",
lens AS (SELECT list(length ORDER BY length) AS ls, list(n_p ORDER BY length) AS want, list(n_q ORDER BY length) AS cap FROM hist),
pairs AS (SELECT row_number() OVER (ORDER BY a.length, abs(a.length - b.length), b.length) AS i,
          a.rank AS ta, b.rank AS db, a.length AS la, b.length AS lb
          FROM (SELECT length, row_number() OVER (ORDER BY length) AS rank FROM hist) a,
               (SELECT length, row_number() OVER (ORDER BY length) AS rank FROM hist) b WHERE a.length <> b.length),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, list_transform(list_zip(want, cap), lambda z: greatest(z[1] - z[2], 0)) AS short,
         list_transform(list_zip(want, cap), lambda z: greatest(z[2] - z[1], 0)) AS room, CAST(0 AS BIGINT) AS moved,
         CAST(0 AS BIGINT) AS la, CAST(0 AS BIGINT) AS lb FROM lens
  UNION ALL
  SELECT p.i, list_transform(w.short, lambda v, k: CASE WHEN k = p.ta THEN v - least(w.short[p.ta], w.room[p.db]) ELSE v END),
         list_transform(w.room, lambda v, k: CASE WHEN k = p.db THEN v - least(w.short[p.ta], w.room[p.db]) ELSE v END),
         least(w.short[p.ta], w.room[p.db]), p.la, p.lb
  FROM walk w JOIN pairs p ON p.i = w.i + 1),
moves AS MATERIALIZED (SELECT la AS target_length, lb AS sampled_length, moved AS n, abs(la - lb) AS distance FROM walk WHERE moved > 0),
quota AS MATERIALIZED (SELECT h.length, CAST(least(n_p, n_q) + coalesce((SELECT sum(n) FROM moves m WHERE m.sampled_length = h.length), 0) AS BIGINT) AS quota FROM hist h),
drawn AS MATERIALIZED (SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY u.length ORDER BY {B.u_sql(SEED, 'library', 'uid')}, uid) AS rn, quota
          FROM uniq u JOIN quota q ON u.length = q.length WHERE label = 'negative') WHERE rn <= quota)"""


def recursive(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


@query("X08_length_matched_library", recursive(LIBRARY, """
SELECT uid, label, CAST(length AS BIGINT) AS length FROM uniq WHERE label = 'positive'
UNION ALL SELECT uid, label, CAST(length AS BIGINT) FROM drawn"""))
def _(t):
    chosen, _, _ = M.length_matched_library(B.unique_rows(t, "toxic"), SEED, "uid")
    return chosen.select("uid", "label", "length")


@query("X08_match_quality", recursive(LIBRARY, f"""
, f AS (SELECT u.*, d.uid IS NOT NULL AS chosen FROM uniq u LEFT JOIN (SELECT uid FROM drawn) d ON u.uid = d.uid),
k AS (SELECT length, count(*) FILTER (label = 'positive') AS a, count(*) FILTER (label = 'negative') AS b, count(*) FILTER (chosen) AS d FROM f GROUP BY 1),
p AS (SELECT *, a / sum(a) OVER () AS pa, b / sum(b) OVER () AS pb, d / sum(d) OVER () AS pd FROM k)
SELECT CAST(sum(a) AS BIGINT) AS positives, CAST(sum(b) AS BIGINT) AS pool, CAST(sum(d) AS BIGINT) AS chosen,
  {R('sum(abs(pa - pb)) / 2')} AS tv_before, {R('sum(abs(pa - pd)) / 2')} AS tv_after,
  {R("(sum(CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pb) / 2)) ELSE 0 END) + sum(CASE WHEN pb > 0 THEN pb * ln(pb / ((pa + pb) / 2)) ELSE 0 END)) / 2")} AS js_before,
  {R("(sum(CASE WHEN pa > 0 THEN pa * ln(pa / ((pa + pd) / 2)) ELSE 0 END) + sum(CASE WHEN pd > 0 THEN pd * ln(pd / ((pa + pd) / 2)) ELSE 0 END)) / 2")} AS js_after,
  {R('sum(a * length) / sum(a)')} AS mean_positive, {R('sum(d * length) / sum(d)')} AS mean_chosen
FROM p""".lstrip()))
def _(t):
    u = B.unique_rows(t, "toxic")
    chosen, _, _ = M.length_matched_library(u, SEED, "uid")
    marks = chosen.where("label = 'negative'").select("uid", F.lit(True).alias("chosen"))
    flagged = u.join(marks, "uid", "left").na.fill({"chosen": False})
    rep = H.distribution_report(flagged, c("chosen"))
    pa, pb, pd = c("positive_probability"), c("pool_probability"), c("final_probability")
    total = lambda k: F.sum(k).alias(k)
    mean = lambda n: F.sum(c(n) * c("length")) / F.sum(n)
    return rep.agg(
        F.sum("positive_count").alias("positives"), F.sum("pool_count").alias("pool"), F.sum("final_count").alias("chosen"),
        S.r6(H.total_variation(pa, pb)).alias("tv_before"), S.r6(H.total_variation(pa, pd)).alias("tv_after"),
        S.r6(H.js_divergence(pa, pb)).alias("js_before"), S.r6(H.js_divergence(pa, pd)).alias("js_after"),
        S.r6(mean("positive_count")).alias("mean_positive"), S.r6(mean("final_count")).alias("mean_chosen"))


@query("A12_distribution_report", B.with_sql(B.UNIQ_B, f"""
, k AS (SELECT s.length, count(*) FILTER (label = 'positive') AS a, count(*) FILTER (label = 'negative') AS b,
   count(*) FILTER (label = 'negative' AND support_count > 1) AS d FROM (SELECT unnest(range(10, 51)) AS length) s LEFT JOIN uniq u ON u.length = s.length GROUP BY 1)
SELECT length, a AS positive_count, b AS pool_count, d AS final_count, {R('a / sum(a) OVER ()')} AS positive_probability,
  {R('b / sum(b) OVER ()')} AS pool_probability, {R('d / sum(d) OVER ()')} AS final_probability, {R('abs(a / sum(a) OVER () - d / sum(d) OVER ())')} AS gap FROM k""".lstrip()))
def _(t):
    rep = H.distribution_report(B.unique_rows(t, "toxic"), c("support_count") > 1)
    return rep.select("length", "positive_count", "pool_count", "final_count",
                      *[S.r6(c(k)).alias(k) for k in ("positive_probability", "pool_probability", "final_probability", "gap")])


@query("A12_limiting_lengths", B.with_sql(PAIR, """
SELECT * FROM (SELECT length, n_p, n_q, n_p - least(n_p, n_q) AS deficit FROM hist ORDER BY deficit DESC, n_p DESC, length LIMIT 10) WHERE n_p > n_q"""))
def _(t):
    return H.limiting_lengths(_pair(t))


# --- balanced strata ------------------------------------------------------------------------------------

STRATA = """, s AS MATERIALIZED (SELECT *, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS label_id, {expr} FROM uniq),
k AS (SELECT {keys}, count(*) FILTER (label_id = 1) AS pos, count(*) FILTER (label_id = 0) AS neg FROM s GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY {part}, s.label_id ORDER BY {u}, uid) AS rn, least(pos, neg) AS quota FROM s JOIN k USING ({keys}))"""


def _labelled_unique(t):
    return SC.with_shortcut_columns(B.unique_rows(t, "toxic")).withColumn("label_id", S.label_id(c("label")))


U_BAL = B.u_sql(SEED, "balance", "uid")


@query("X11_balanced_strata", B.with_sql(B.UNIQ_B + STRATA.format(expr="starts_with(sequence, 'M') AS starts_m", keys="starts_m", part="s.starts_m", u=U_BAL),
       "SELECT uid, label_id, starts_m FROM r WHERE rn <= quota"))
def _(t):
    return M.balance_classes(_labelled_unique(t), ["starts_m"], SEED, "uid").select("uid", "label_id", "starts_m")


@query("X11_strata_report", B.with_sql(B.UNIQ_B, """
SELECT starts_with(sequence, 'M') AS starts_m, count(*) FILTER (label = 'positive') AS positive_available,
  count(*) FILTER (label = 'negative') AS negative_available, least(count(*) FILTER (label = 'positive'), count(*) FILTER (label = 'negative')) AS selected_per_class
FROM uniq GROUP BY 1"""))
def _(t):
    return M.balance_report(_labelled_unique(t), ["starts_m"])


CANDIDATE_BINS = (20, 16, 12, 10, 8, 5)
FREQ = f"({B.count_sql('sequence', 'C')} / greatest(length(sequence), 1))::DOUBLE"
BIN_SQL = "(len(list_filter(list_transform(range(0, bins + 1), lambda i: i * (1.0::DOUBLE / bins)), lambda e: e < c_frequency)) - 1)"
CELL_SQL = "(len(list_filter(list_transform(range(0, bins), lambda i: CASE WHEN i = 0 THEN -1e-12 ELSE i * (1.0::DOUBLE / bins) END), lambda e: e <= c_frequency)) - 1)"
BINNED = B.UNIQ_B + f""", f AS MATERIALIZED (SELECT *, {FREQ} AS c_frequency FROM uniq),
tried AS MATERIALIZED (SELECT *, unnest([20, 16, 12, 10, 8, 5]) AS bins FROM f)""" + STRATA.format(
    expr=f"{BIN_SQL} AS bin", keys="bins, bin", part="s.bins, s.bin", u=U_BAL).replace("FROM uniq)", "FROM tried)", 1)


@query("X12_bin_matched", B.with_sql(BINNED, "SELECT uid, label_id, CAST(bin AS BIGINT) AS bin FROM r WHERE rn <= quota AND bins = 20"))
def _(t):
    matched = M.bin_matched(_labelled_unique(t), "c_frequency", [20], SEED, "uid")
    return matched.select("uid", "label_id", c("bin").cast("long").alias("bin"))


@query("X13_bin_search", B.with_sql(BINNED, f"""
, kept AS (SELECT *, {CELL_SQL} AS cell FROM r WHERE rn <= quota),
g AS (SELECT bins, cell, count(*) FILTER (label_id = 1) AS pos, count(*) FILTER (label_id = 0) AS neg FROM kept GROUP BY ALL),
sh AS (SELECT *, pos / sum(pos) OVER (PARTITION BY bins) AS p, neg / sum(neg) OVER (PARTITION BY bins) AS q FROM g),
sc AS (SELECT bins, CAST(sum(pos + neg) AS BIGINT) AS n_total, sum(abs(p - q)) / 2 AS tv,
  sqrt(greatest((sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)) AS js FROM sh GROUP BY 1)
SELECT CAST(bins AS BIGINT) AS bins, n_total, {R('js')} AS js, {R('tv')} AS tv, row_number() OVER (ORDER BY {R('js')}, {R('tv')}, n_total DESC, list_position([20, 16, 12, 10, 8, 5], bins)) = 1 AS best FROM sc""".lstrip()))
def _(t):
    matched = M.bin_matched(_labelled_unique(t), "c_frequency", CANDIDATE_BINS, SEED, "uid")
    attempts = M.bin_attempts(matched, "c_frequency", CANDIDATE_BINS).select(
        "bins", "n_total", S.r6(c("js")).alias("js"), S.r6(c("tv")).alias("tv"))
    best = M.best_bins(attempts, CANDIDATE_BINS).select(c("bins").alias("best_bins"))
    return attempts.crossJoin(F.broadcast(best)).select(  # one row on the right
        c("bins").cast("long").alias("bins"), "n_total", "js", "tv", (c("bins") == c("best_bins")).alias("best"))


@query("X15_distinct_cap_sample", f"SELECT text FROM (SELECT DISTINCT text FROM documents) ORDER BY {B.u_sql(SEED, 'cap', 'text')}, text LIMIT 500")
def _(t):
    return M.distinct_cap_sample(t.documents, "text", 500, SEED)


@query("X16_length_draws", B.with_sql(B.RECORDS, f"""
, h AS (SELECT length, count(*) AS n FROM records GROUP BY 1),
cdf AS (SELECT length, sum(n) OVER (ORDER BY length) / sum(n) OVER () AS cdf FROM h),
d AS (SELECT doc_id, {B.u_sql(SEED, 'len', 'doc_id')} AS u FROM documents)
SELECT doc_id, CAST((SELECT min(length) FROM cdf WHERE cdf > u) AS BIGINT) AS length FROM d""".lstrip()))
def _(t):
    shape = H.length_counts(B.records(t))
    return M.draw_lengths(shape, t.documents.select("doc_id"), S.unit_hash(SEED, "len", c("doc_id")))


@query("X17_frame_slice", """
SELECT event_id FROM (SELECT event_id, dense_rank() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 10 AND i < 5000 AND (i - 10) % 7 = 0""")
def _(t):
    from ..operators.frames import frame_slice

    frames = t.events.select("event_id")
    return frame_slice(ranking.global_position(frames, [c("event_id").asc()], "i").withColumn("i", c("i") - 1), "i", 10, 5000, 7).select("event_id")


@query("X18_stratified_folds", f"""
SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic ORDER BY {B.u_sql(SEED, 'fold', 'doc_id')}, doc_id) - 1) % 5 AS BIGINT) AS fold FROM labels""")
def _(t):
    return M.stratified_folds(t.labels, "toxic", 5, SEED, "doc_id").select("doc_id", "toxic", "fold")


# --- shortcut profiles -----------------------------------------------------------------------------------

@query("A13_shortcut_profile", B.with_sql(B.LABELLED_B, f"""
, s AS (SELECT source_split AS split, label, starts_with(sequence, 'M')::INT AS m, contains(sequence, 'C')::INT AS h,
   {B.count_sql('sequence', 'C')} AS cc, {B.count_sql('sequence', 'C')} / length(sequence) AS cf FROM labelled),
g AS (SELECT split, label, count(*) AS n, sum(m)::DOUBLE AS sm, sum(h)::DOUBLE AS sh, avg(cf) AS af, sum(cc)::DOUBLE AS sc FROM s GROUP BY ALL)
SELECT split, label, n, 'starts_with_M_proportion' AS metric, {R('sm / n')} AS value, sm AS count FROM g
UNION ALL SELECT split, label, n, 'contains_C_proportion', {R('sh / n')}, sh FROM g
UNION ALL SELECT split, label, n, 'mean_C_frequency', {R('af')}, sc FROM g
UNION ALL SELECT split, label, n, 'mean_C_count', {R('sc / n')}, sc FROM g""".lstrip()))
def _(t):
    df = B.labelled(t, "toxic").withColumnRenamed("source_split", "split")
    return SC.shortcut_profile(df, ["split", "label"]).withColumn("value", S.r6(c("value")))


BIAS_SQL = f""", bias AS (SELECT source_db AS dataset, count(*) AS n, avg(starts_with(sequence, 'M')::INT) AS m_start_rate,
  avg(contains(sequence, 'C')::INT) AS contains_c_rate, avg({B.count_sql('sequence', 'C')} / length(sequence)) AS mean_c_frequency FROM records GROUP BY 1)"""
BIAS_VALUES = ("m_start_rate", "contains_c_rate", "mean_c_frequency")


@query("A14_bias_statistics", B.with_sql(B.RECORDS + BIAS_SQL, f"SELECT dataset, n, {', '.join(f'{R(v)} AS {v}' for v in BIAS_VALUES)} FROM bias"))
def _(t):
    stats = SC.bias_statistics(B.records(t).withColumnRenamed("source_db", "dataset"), "dataset")
    return stats.select("dataset", "n", *[S.r6(c(v)).alias(v) for v in BIAS_VALUES])


@query("A15_pair_deltas", B.with_sql(B.RECORDS + BIAS_SQL, f"""
SELECT a.dataset AS positive_set, b.dataset AS negative_set, {', '.join(f'{R(f"a.{v} - b.{v}")} AS delta_{v}' for v in BIAS_VALUES)}
FROM bias a JOIN bias b ON (a.dataset, b.dataset) IN (('src0', 'src1'), ('src2', 'src3'), ('src4', 'src5'))"""))
def _(t):
    stats = SC.bias_statistics(B.records(t).withColumnRenamed("source_db", "dataset"), "dataset")
    pairs = [("src0", "src1"), ("src2", "src3"), ("src4", "src5")]
    out = SC.pair_deltas(stats, "dataset", pairs, BIAS_VALUES)
    return out.select("positive_set", "negative_set", *[S.r6(c(f"delta_{v}")).alias(f"delta_{v}") for v in BIAS_VALUES])


# --- cluster-aware splits -----------------------------------------------------------------------------------

@query("J02_cluster_membership", """
SELECT o.o_orderkey AS member, CASE WHEN c.c_custkey IS NULL THEN 'fallback_singleton::' || o.o_orderkey ELSE CAST(o.o_custkey AS VARCHAR) END AS cluster_id
FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') c ON c.c_custkey = o.o_custkey""")
def _(t):
    kept = t.customer.where("c_mktsegment <> 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    membership = t.orders.join(kept, "o_custkey", "left_semi").select(c("o_orderkey").alias("member"), c("o_custkey").alias("cluster_id"))
    return M.attach_clusters(t.orders.select(c("o_orderkey").alias("member")), membership, "member")


@query("A31_cluster_shape", """
SELECT o_custkey AS cluster_id, count(*) AS size, count(*) FILTER (o_orderstatus = 'F') AS pos, count(*) FILTER (o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1""")
def _(t):
    return M.cluster_shapes(t.orders.withColumnRenamed("o_custkey", "cluster_id"), "cluster_id", c("o_orderstatus") == "F")


def _walk_sql(relative: bool, labels: bool) -> str:
    pos = "count(*) FILTER (o_orderstatus = 'F')" if labels else "CAST(0 AS BIGINT)"
    neg = "count(*) FILTER (o_orderstatus <> 'F')" if labels else "CAST(0 AS BIGINT)"

    def cost(k: str, ratio: float) -> str:
        terms = []
        for axis, column in (("t", "size"), ("p", "pos"), ("n", "neg")):
            goal = f"(g{axis} * {ratio}::DOUBLE)"
            change = f"(abs({k}{axis} + {column} - {goal}) - abs({k}{axis} - {goal}))"
            terms.append(f"{change} / greatest({goal}, 1)" if relative else change)
        return f"round({' + '.join(terms)}, 9)"

    names = ["sa", "sb", "sc"]
    state = [f"{k}{axis}" for k in names for axis in "tpn"]
    grow = ", ".join(
        f"{k}{axis} + CASE WHEN pick = {i} THEN {column} ELSE 0 END"
        for i, k in enumerate(names) for axis, column in (("t", "size"), ("p", "pos"), ("n", "neg")))
    return f"""shapes AS MATERIALIZED (SELECT o_custkey AS cluster_id, count(*) AS size, {pos} AS pos, {neg} AS neg FROM orders GROUP BY 1),
ord AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY size DESC, pos DESC, neg DESC, {B.u_sql(SEED, 'cluster', 'cluster_id')}, cluster_id) AS i FROM shapes),
goal AS MATERIALIZED (SELECT CAST(sum(size) AS BIGINT) AS gt, CAST(sum(pos) AS BIGINT) AS gp, CAST(sum(neg) AS BIGINT) AS gn FROM shapes),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, -1 AS pick, {', '.join(f'CAST(0 AS BIGINT) AS {s}' for s in state)}
  UNION ALL
  SELECT i, pick, {grow} FROM (
    SELECT *, CASE WHEN k0 <= k1 AND k0 <= k2 THEN 0 WHEN k1 <= k2 THEN 1 ELSE 2 END AS pick FROM (
      SELECT o.i, o.size, o.pos, o.neg, {', '.join(f'w.{s}' for s in state)}, {cost('sa', 0.8)} AS k0, {cost('sb', 0.1)} AS k1, {cost('sc', 0.1)} AS k2
      FROM walk w JOIN ord o ON o.i = w.i + 1, goal))),
placed AS MATERIALIZED (SELECT ord.cluster_id, ['train', 'val', 'test'][pick + 1] AS split FROM walk JOIN ord ON ord.i = walk.i)"""


def _split(t, labels: bool):
    members = t.orders.select("o_orderkey", c("o_custkey").alias("cluster_id"), "o_orderstatus")
    return M.cluster_split(members, "cluster_id", c("o_orderstatus") == "F", SEED, use_labels=labels)


@query("X09_cluster_split", recursive(_walk_sql(True, True), """
SELECT o.o_orderkey, o.o_custkey AS cluster_id, p.split FROM orders o JOIN placed p ON p.cluster_id = o.o_custkey"""))
def _(t):
    return _split(t, True).select("o_orderkey", "cluster_id", "split")


@query("X10_size_split", recursive(_walk_sql(False, False), """
SELECT o.o_orderkey, o.o_custkey AS cluster_id, p.split FROM orders o JOIN placed p ON p.cluster_id = o.o_custkey"""))
def _(t):
    return _split(t, False).select("o_orderkey", "cluster_id", "split")


@query("A32_split_summary", recursive(_walk_sql(True, True), """
SELECT split, count(DISTINCT o_custkey) AS clusters, count(*) AS unique_sequences, count(*) FILTER (o_orderstatus = 'F') AS positive_unique,
       count(*) FILTER (o_orderstatus <> 'F') AS negative_unique
FROM orders o JOIN placed p ON p.cluster_id = o.o_custkey GROUP BY 1"""))
def _(t):
    return M.split_summary(_split(t, True), "cluster_id", c("o_orderstatus") == "F")
