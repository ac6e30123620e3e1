"""Evaluation metrics, significance tests and metric-table comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import comparison as K, curation as C, metrics as M, resampling as RS
from . import base as B
from .registry import query

c = F.col
R = B.r6_sql
SEED = 42


def rounded(df, keys, values):
    return df.select(*keys, *[S.r6(c(v)).alias(v) for v in values])


CONF = B.PRED + """, conf AS MATERIALIZED (SELECT model, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp,
  count(*) FILTER (label = 0 AND prob < 0.5) AS tn, count(*) FILTER (label = 1 AND prob < 0.5) AS fn FROM pred GROUP BY 1)"""


def metrics_sql(source: str, keys: str) -> str:
    """Threshold metrics from weighted counts in ``source``."""
    d = lambda top, bottom: f"CASE WHEN ({bottom}) = 0 THEN 0.0 ELSE ({top})::DOUBLE / ({bottom}) END"
    return f"""SELECT {keys}, {d('tp', 'tp + fn')} AS sensitivity, {d('tn', 'tn + fp')} AS specificity, {d('tp', 'tp + fp')} AS "precision", {d('tn', 'tn + fn')} AS npv,
  {d('tp + tn', 'tp + tn + fp + fn')} AS accuracy, ({d('tp', 'tp + fn')} + {d('tn', 'tn + fp')}) / 2 AS balanced_accuracy, {d('2 * tp', '2 * tp + fp + fn')} AS f1,
  {d('tp::DOUBLE * tn - fp::DOUBLE * fn', 'sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)')} AS mcc FROM {source}"""


def ranking_sql(source: str, keys: str, weight: str = "1") -> str:
    """ROC-AUC and average precision from distinct scores."""
    return f"""SELECT {keys}, sum(neg * (above + pos / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc,
  sum(pos * ((above + pos) / (above + pos + fabove + neg))) / sum(pos) AS pr_auc FROM (
  SELECT *, coalesce(sum(pos) OVER w, 0) AS above, coalesce(sum(neg) OVER w, 0) AS fabove FROM (
    SELECT {keys}, prob, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END)::DOUBLE AS neg FROM {source} GROUP BY ALL)
  WINDOW w AS (PARTITION BY {keys} ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY {keys}"""


TM = M.THRESHOLD_METRICS
TM_SQL = ", ".join(f'{R(chr(34) + m + chr(34))} AS "{m}"' for m in TM)


@query("M01_confusion", B.with_sql(CONF, "SELECT model, tp, fp, tn, fn FROM conf"))
def _(t):
    return M.confusion(B.predictions(t), ["model"], c("prob") >= 0.5)


@query("M02_threshold_metrics", B.with_sql(CONF, f"SELECT model, {TM_SQL} FROM ({metrics_sql('conf', 'model')})"))
def _(t):
    return rounded(M.threshold_metrics(M.confusion(B.predictions(t), ["model"], c("prob") >= 0.5)), ["model"], TM)


@query("M03_roc_auc", B.with_sql(B.PRED, f"SELECT model, {R('roc_auc')} AS roc_auc FROM ({ranking_sql('pred', 'model')})"))
def _(t):
    return rounded(M.ranking_metrics(B.predictions(t), ["model"]), ["model"], ["roc_auc"])


@query("M04_average_precision", B.with_sql(B.PRED, f"SELECT model, {R('pr_auc')} AS pr_auc FROM ({ranking_sql('pred', 'model')})"))
def _(t):
    return rounded(M.ranking_metrics(B.predictions(t), ["model"]), ["model"], ["pr_auc"])


@query("M05_best_threshold", B.with_sql(B.PRED, f"""
, grid AS (SELECT model, unnest(list_distinct(quantile_cont(prob, [{', '.join(f'{0.02 + 0.01 * i:.2f}' for i in range(97))}]))) AS threshold FROM pred GROUP BY 1),
sc AS (SELECT model, prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM pred GROUP BY ALL),
tot AS (SELECT model, sum(pos) AS p, sum(neg) AS n FROM sc GROUP BY 1),
hit AS (SELECT g.model, g.threshold, sum(pos) AS tp, sum(neg) AS fp FROM grid g JOIN sc ON sc.model = g.model AND sc.prob >= g.threshold GROUP BY ALL),
val AS (SELECT hit.model, threshold, round((tp / p + (n - fp) / n) / 2 * 1e12) / 1e12 AS balanced FROM hit JOIN tot ON tot.model = hit.model)
SELECT model, {R('threshold')} AS threshold, {R('balanced')} AS balanced_accuracy FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY balanced DESC, threshold) AS i FROM val) WHERE i = 1""".lstrip()))
def _(t):
    return rounded(M.best_thresholds(B.predictions(t), ["model"]), ["model"], ["threshold", "balanced_accuracy"])


@query("M06_log_loss", B.with_sql(B.PRED, f"""
SELECT model, {R('avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z))))')} AS loss FROM (SELECT model, label, (prob - 0.5) * 8 AS z FROM pred) GROUP BY 1"""))
def _(t):
    return rounded(M.log_loss(B.predictions(t), ["model"], (c("prob") - 0.5) * 8), ["model"], ["loss"])


@query("M07_seed_ensemble", f"""
SELECT l_orderkey AS id, {R('avg(l_discount * 10)')} AS score, {R('stddev_pop(l_discount * 10)')} AS score_std,
  {', '.join(f'coalesce(max(CASE WHEN l_linenumber = {s} THEN l_discount * 10 END), -1.0) AS prob_seed{s}' for s in (1, 2, 3))} FROM lineitem GROUP BY 1""")
def _(t):
    df = t.lineitem.select(c("l_orderkey").alias("id"), c("l_linenumber").alias("seed"), (c("l_discount") * 10).alias("prob"))
    out = M.seed_ensemble(df, ["id"], "seed", [1, 2, 3])
    return out.select("id", S.r6(c("score")).alias("score"), S.r6(c("score_std")).alias("score_std"), *[F.coalesce(f"prob_seed{s}", F.lit(-1.0)).alias(f"prob_seed{s}") for s in (1, 2, 3)])


# --- resampling -------------------------------------------------------------------------------------

N_BOOT, N_SWAPS = 200, 200
CUTS = RS.poisson_cuts()


def boot_sql(n: int) -> str:
    weight = " + ".join(f"(p >= '{cut}')::INT" for cut in CUTS)
    return f""", hashed AS (SELECT pred.*, b.b, md5(concat_ws('|', '{SEED}', 'boot', cand_id, CAST(b.b AS VARCHAR))) AS h FROM pred, (SELECT unnest(range(0, {(n - 1) // 8 + 1})) AS b) b),
lanes AS (SELECT model, label, prob, CAST(b * 8 + i AS INT) AS replicate, substr(h, CAST(4 * i + 1 AS INT), 4) AS p FROM hashed, (SELECT unnest(range(0, 8)) AS i) l),
weighted AS MATERIALIZED (SELECT model, label, prob, replicate, {weight} AS w FROM lanes WHERE replicate < {n}),
bconf AS (SELECT model, replicate, sum(w) FILTER (label = 1 AND prob >= 0.5) AS tp, sum(w) FILTER (label = 0 AND prob >= 0.5) AS fp,
  sum(w) FILTER (label = 0 AND prob < 0.5) AS tn, sum(w) FILTER (label = 1 AND prob < 0.5) AS fn FROM weighted GROUP BY ALL),
boot AS MATERIALIZED (SELECT * FROM ({metrics_sql('bconf', 'model, replicate')}))"""


def _boot(t, n=N_BOOT):
    return RS.bootstrap_metrics(B.predictions(t), ["model"], "cand_id", 0.5, n, SEED)


@query("M08_bootstrap_ci", B.with_sql(B.PRED + boot_sql(N_BOOT), f"""
SELECT model, metric, {R('quantile_cont(value, 0.025)')} AS low, {R('quantile_cont(value, 0.975)')} AS high FROM (
  UNPIVOT boot ON sensitivity, specificity, "precision", npv, accuracy, balanced_accuracy, f1, mcc INTO NAME metric VALUE value) GROUP BY ALL"""))
def _(t):
    long = _boot(t).unpivot(["model", "replicate"], list(TM), "metric", "value")
    return rounded(RS.interval(long, ["model", "metric"], "value"), ["model", "metric"], ["low", "high"])


@query("M08_bootstrap_auc", B.with_sql(B.PRED + boot_sql(N_BOOT), f"""
SELECT model, {R('quantile_cont(roc_auc, 0.025)')} AS low, {R('quantile_cont(roc_auc, 0.975)')} AS high FROM (
  {ranking_sql("(SELECT model, replicate, label, prob, w FROM weighted)", 'model, replicate', 'w')}) GROUP BY model"""))
def _(t):
    df = B.predictions(t)
    auc = RS.bootstrap_ranking(df, ["model"], "cand_id", N_BOOT, SEED)
    return rounded(RS.interval(auc, ["model"], "roc_auc"), ["model"], ["low", "high"])


DELTA = B.PRED + boot_sql(N_BOOT) + """, delta AS (SELECT replicate, max(CASE WHEN model = 'a' THEN mcc END) - max(CASE WHEN model = 'm' THEN mcc END) AS delta FROM boot GROUP BY 1),
conf AS (SELECT model, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp,
  count(*) FILTER (label = 0 AND prob < 0.5) AS tn, count(*) FILTER (label = 1 AND prob < 0.5) AS fn FROM pred GROUP BY 1)"""


@query("M09_bootstrap_delta", B.with_sql(DELTA, f"""
, obs AS (SELECT max(CASE WHEN model = 'a' THEN mcc END) - max(CASE WHEN model = 'm' THEN mcc END) AS observed FROM ({metrics_sql('conf', 'model')}))
SELECT {R('any_value(observed)')} AS observed, {R('quantile_cont(delta, 0.025)')} AS low, {R('quantile_cont(delta, 0.975)')} AS high,
  {R('CASE WHEN any_value(observed) <= 0 THEN 1.0 ELSE (count(*) FILTER (delta <= 0) + 1) / (count(*) + 1) END')} AS p_value FROM delta, obs""".lstrip()))
def _(t):
    deltas = RS.paired_deltas(_boot(t), "model", "a", "m", ["replicate"], "mcc")
    values = M.threshold_metrics(M.confusion(B.predictions(t), ["model"], c("prob") >= 0.5))
    observed = RS.paired_deltas(values, "model", "a", "m", [], "mcc").select(c("delta").alias("observed"))
    joined = deltas.crossJoin(F.broadcast(observed))  # one row on the right
    out = joined.agg(
        F.max("observed").alias("observed"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"),
        F.when(F.max("observed") <= 0, 1.0).otherwise((F.count_if(c("delta") <= 0) + 1) / (F.count("*") + 1)).alias("p_value"))
    return rounded(out, [], out.columns)


@query("M10_permutation_test", B.with_sql(B.CAND, f"""
, h AS (SELECT label, score_a, score_m, b, md5(concat_ws('|', '{SEED}', 'swap', cand_id, CAST(b AS VARCHAR))) AS h FROM cand, (SELECT unnest(range(0, {(N_SWAPS - 1) // 32 + 1})) AS b)),
l AS (SELECT label, b * 32 + i AS replicate, substr(h, CAST(i + 1 AS INT), 1) >= '8' AS sw, score_a, score_m FROM h, (SELECT unnest(range(0, 32)) AS i)),
x AS (SELECT replicate, label, CASE WHEN sw THEN score_m ELSE score_a END AS pa, CASE WHEN sw THEN score_a ELSE score_m END AS pb FROM l WHERE replicate < {N_SWAPS}
      UNION ALL SELECT -1, label, score_a, score_m FROM cand),
y AS (SELECT replicate, 'a' AS model, label, pa AS p FROM x UNION ALL SELECT replicate, 'b', label, pb FROM x),
xc AS (SELECT replicate, model, count(*) FILTER (label = 1 AND p >= 0.5) AS tp, count(*) FILTER (label = 0 AND p >= 0.5) AS fp,
  count(*) FILTER (label = 0 AND p < 0.5) AS tn, count(*) FILTER (label = 1 AND p < 0.5) AS fn FROM y GROUP BY ALL),
xm AS (SELECT * FROM ({metrics_sql('xc', 'replicate, model')})),
u AS (UNPIVOT xm ON sensitivity, specificity, "precision", npv, accuracy, balanced_accuracy, f1, mcc INTO NAME metric VALUE value),
d AS (SELECT replicate, metric, max(CASE WHEN model = 'a' THEN value END) - max(CASE WHEN model = 'b' THEN value END) AS delta FROM u GROUP BY ALL),
o AS (SELECT metric, delta AS observed FROM d WHERE replicate = -1)
SELECT metric, {R('any_value(observed)')} AS observed, {R('CASE WHEN any_value(observed) <= 0 THEN 1.0 ELSE (count(*) FILTER (delta >= observed - 1e-12) + 1) / (count(*) + 1) END')} AS p_value
FROM d JOIN o USING (metric) WHERE replicate >= 0 GROUP BY metric""".lstrip()))
def _(t):
    pairs = B.candidates(t).select("cand_id", "label", c("score_a").alias("prob_a"), c("score_m").alias("prob_b"))
    out = RS.permutation_p(RS.permutation_deltas(pairs, "cand_id", 0.5, N_SWAPS, SEED))
    return rounded(out, ["metric"], ["observed", "p_value"])


def _pairs(t):
    return B.candidates(t).select("pool", "cand_id", "label", c("score_a").alias("prob_a"), c("score_m").alias("prob_b"))


@query("M11_discordant_counts", B.with_sql(B.CAND, """
SELECT pool, count(*) FILTER ((score_a >= 0.5) = (label = 1) AND (score_m >= 0.5) <> (label = 1)) AS a_only,
  count(*) FILTER ((score_a >= 0.5) <> (label = 1) AND (score_m >= 0.5) = (label = 1)) AS b_only FROM cand GROUP BY 1"""))
def _(t):
    return RS.discordant_counts(_pairs(t), ["pool"], 0.5)


@query("M11_mcnemar", B.with_sql(B.CAND, f"""
, k AS (SELECT pool, count(*) FILTER ((score_a >= 0.5) = (label = 1) AND (score_m >= 0.5) <> (label = 1)) AS a_only,
  count(*) FILTER ((score_a >= 0.5) <> (label = 1) AND (score_m >= 0.5) = (label = 1)) AS b_only FROM cand GROUP BY 1),
term AS (SELECT *, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS p FROM (
  SELECT *, a_only + b_only AS n, unnest(range(a_only, a_only + b_only + 1)) AS i FROM k))
SELECT pool, a_only, b_only, {R('CASE WHEN a_only = 0 THEN 1.0 ELSE least(1.0, sum(p)) END')} AS p_value FROM term GROUP BY pool, a_only, b_only""".lstrip()))
def _(t):
    return rounded(RS.with_mcnemar_p(RS.discordant_counts(_pairs(t), ["pool"], 0.5)), ["pool", "a_only", "b_only"], ["p_value"])


@query("M12_significance_table", B.with_sql(B.PRED + boot_sql(N_BOOT) + """, conf AS (SELECT model, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp,
  count(*) FILTER (label = 0 AND prob < 0.5) AS tn, count(*) FILTER (label = 1 AND prob < 0.5) AS fn FROM pred GROUP BY 1)""", f"""
, obs AS (SELECT * FROM ({metrics_sql('conf', 'model')})),
ol AS (UNPIVOT obs ON sensitivity, specificity, "precision", npv, accuracy, balanced_accuracy, f1, mcc INTO NAME metric VALUE value),
bl AS (UNPIVOT boot ON sensitivity, specificity, "precision", npv, accuracy, balanced_accuracy, f1, mcc INTO NAME metric VALUE value),
ci AS (SELECT model, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM bl GROUP BY ALL),
best AS (SELECT metric, arg_max(model, value) AS best_model FROM ol GROUP BY 1)
SELECT ol.model, ol.metric, {R('value')} AS value, {R('low')} AS low, {R('high')} AS high, best_model = ol.model AS is_best FROM ol JOIN ci USING (model, metric) JOIN best USING (metric)""".lstrip()))
def _(t):
    values = M.threshold_metrics(M.confusion(B.predictions(t), ["model"], c("prob") >= 0.5)).unpivot(["model"], list(TM), "metric", "value")
    boots = _boot(t).unpivot(["model", "replicate"], list(TM), "metric", "value")
    table = K.mark_best(values, ["metric"], "value").join(RS.interval(boots, ["model", "metric"], "value"), ["model", "metric"])
    return rounded(table, ["model", "metric", "is_best"], ["value", "low", "high"])


# --- metric tables ---------------------------------------------------------------------------------------

SUMMARY_VALUES = ("mean_roc", "std_roc", "mean_pr", "std_pr")


@query("A16_seed_summary", B.with_sql(B.RESULTS, f"""
SELECT task, model, split, {', '.join(f'{R(f"{f}({m})")} AS {n}_{m}' for m in ('roc', 'pr') for n, f in (('mean', 'avg'), ('std', 'stddev_pop'), ('min', 'min'), ('max', 'max')))},
  count(DISTINCT seed) AS n_seeds FROM results GROUP BY ALL"""))
def _(t):
    out = K.seed_summary(B.results(t), ["task", "model", "split"], ["roc", "pr"], extremes=True)
    return rounded(out, ["task", "model", "split", "n_seeds"], [x for x in out.columns if x[:4] in ("mean", "std_", "min_", "max_")])


@query("A17_describe", B.with_sql(B.CAND, f"""
SELECT pool, count(*) AS count, {R('avg(score_a)')} AS mean, {R('median(score_a)')} AS median, {R('quantile_cont(score_a, 0.75)')} AS p75,
  {R('quantile_cont(score_a, 0.9)')} AS p90, {R('max(score_a)')} AS max FROM cand GROUP BY 1"""))
def _(t):
    return rounded(K.describe(B.candidates(t), ["pool"], "score_a"), ["pool", "count"], ["mean", "median", "p75", "p90", "max"])


@query("A24_loss_curve", B.with_sql(B.METRIC_ROWS, f"""
SELECT task, model, split, {R('avg(roc)')} AS mean_roc, {R('coalesce(stddev_samp(roc), 0)')} AS std_roc, count(DISTINCT seed) AS n_seeds FROM metric_rows GROUP BY ALL"""))
def _(t):
    out = K.loss_curve(B.metric_rows(t), ["task", "model", "split"], ["roc"])
    return rounded(out, ["task", "model", "split", "n_seeds"], ["mean_roc", "std_roc"])


@query("A25_pivot_metric", B.with_sql(B.SUMMARY, f"""
SELECT model, split, {', '.join(f"{R(f'max(CASE WHEN task = {chr(39)}{x}{chr(39)} THEN mean_roc END)')} AS {x}" for x in ('click', 'view'))} FROM summary GROUP BY ALL"""))
def _(t):
    out = K.pivot_metric(B.summary(t), ["model", "split"], "task", ["click", "view"], "mean_roc")
    return rounded(out, ["model", "split"], ["click", "view"])


DELTAS = B.RESULTS + """, wide AS (SELECT task, split, seed, max(CASE WHEN model = 'm0' THEN roc END) - max(CASE WHEN model = 'm1' THEN roc END) AS roc,
  max(CASE WHEN model = 'm0' THEN pr END) - max(CASE WHEN model = 'm1' THEN pr END) AS pr FROM results GROUP BY ALL),
deltas AS MATERIALIZED (SELECT task, split, seed, 'roc' AS metric, roc AS delta FROM wide UNION ALL SELECT task, split, seed, 'pr', pr FROM wide),
stats AS MATERIALIZED (SELECT task, split, metric, avg(delta) AS mean_delta, stddev_samp(delta) AS sd_delta, count(*) FILTER (delta > 0) AS seeds_improved, count(delta) AS seeds_total,
  string_agg(seed || ':' || {fmt}, '; ' ORDER BY seed) FILTER (delta IS NOT NULL) AS seed_deltas FROM deltas GROUP BY ALL)"""


def fixed4_sql(value: str, signed: bool = False) -> str:
    k = f"CAST(round(({value}) * 1e4) AS BIGINT)"
    sign = f"CASE WHEN {k} < 0 THEN '-' ELSE '{'+' if signed else ''}' END"
    return f"({sign} || (abs({k}) // 10000) || '.' || lpad(CAST(abs({k}) % 10000 AS VARCHAR), 4, '0'))"


DELTAS = DELTAS.replace("{fmt}", fixed4_sql("delta", True))


def _deltas(t):
    return K.seed_deltas(B.results(t), ["task", "split", "seed"], "m0", "m1", ["roc", "pr"])


@query("J11_paired_comparison", B.with_sql(DELTAS, f"SELECT task, split, seed, metric, {R('delta')} AS delta FROM deltas WHERE delta IS NOT NULL"))
def _(t):
    return rounded(_deltas(t).where("delta IS NOT NULL"), ["task", "split", "seed", "metric"], ["delta"])


@query("A28_paired_delta_stats", B.with_sql(DELTAS, f"SELECT task, split, metric, {R('mean_delta')} AS mean_delta, {R('sd_delta')} AS sd_delta, seeds_improved, seeds_total, seed_deltas FROM stats"))
def _(t):
    out = K.delta_statistics(_deltas(t), ["task", "split", "metric"])
    return rounded(out, ["task", "split", "metric", "seeds_improved", "seeds_total", "seed_deltas"], ["mean_delta", "sd_delta"])


@query("M13_gain_tables", B.with_sql(DELTAS, f"""
SELECT task, split, metric, 'delta ' || {fixed4_sql('mean_delta', True)} AS gain, seeds_improved || '/' || seeds_total AS seed_wins FROM stats WHERE mean_delta > 0.0005 AND seeds_improved >= 2"""))
def _(t):
    return K.key_gains(K.delta_statistics(_deltas(t), ["task", "split", "metric"])).select("task", "split", "metric", "gain", "seed_wins")


@query("M13_positive_gains", B.with_sql(B.SUMMARY, f"""
, d AS (SELECT task, split, max(CASE WHEN model = 'm0' THEN mean_roc END) - max(CASE WHEN model = 'm1' THEN mean_roc END) AS roc,
  max(CASE WHEN model = 'm0' THEN mean_pr END) - max(CASE WHEN model = 'm1' THEN mean_pr END) AS pr FROM summary GROUP BY ALL)
SELECT task, split, metric, {R('gain')} AS gain FROM (UNPIVOT d ON roc, pr INTO NAME metric VALUE gain) WHERE gain > 0.0005""".lstrip()))
def _(t):
    d = K.model_deltas(B.summary(t), ["task", "split"], "m0", "m1", ["roc", "pr"])
    return rounded(K.positive_gains(d, ["task", "split"], ["roc", "pr"]), ["task", "split", "metric"], ["gain"])


@query("M14_best_marks", B.with_sql(B.SUMMARY, f"""
SELECT task, split, model, {R('mean_roc')} AS mean_roc, mean_roc = max(mean_roc) OVER w AS best, mean_roc >= max(mean_roc) OVER w - 0.0005 AS tied FROM summary WINDOW w AS (PARTITION BY task, split)"""))
def _(t):
    exact = K.mark_best(B.summary(t), ["task", "split"], "mean_roc").withColumnRenamed("is_best", "best")
    out = K.mark_best(exact, ["task", "split"], "mean_roc", "slack").withColumnRenamed("is_best", "tied")
    return rounded(out, ["task", "split", "model", "best", "tied"], ["mean_roc"])


@query("M15_context_table", B.with_sql(B.SUMMARY, f"""
, w AS (SELECT task, split, {', '.join(f"max(CASE WHEN model = 'm{i}' THEN mean_roc END) AS m{i}" for i in range(4))} FROM summary WHERE (task, split) IN (('click', 'hard'), ('view', 'hard'), ('view', 'test')) GROUP BY ALL)
SELECT task, split, {', '.join(f'{R(f"m{i}")} AS m{i}' for i in range(4))}, {R('m0 - m1')} AS vs_concat, {R('m0 - greatest(m2, m3)')} AS vs_best_single FROM w""".lstrip()))
def _(t):
    spec = t.spark.createDataFrame([("click", "hard"), ("view", "hard"), ("view", "test")], ["task", "split"])
    kept = B.summary(t).join(F.broadcast(spec), ["task", "split"], "left_semi")
    wide = K.pivot_metric(kept, ["task", "split"], "model", ["m0", "m1", "m2", "m3"], "mean_roc")
    wide = wide.withColumn("vs_concat", c("m0") - c("m1")).withColumn("vs_best_single", c("m0") - F.greatest("m2", "m3"))
    return rounded(wide, ["task", "split"], ["m0", "m1", "m2", "m3", "vs_concat", "vs_best_single"])


@query("J16_best_other", B.with_sql(B.SUMMARY, f"""
, o AS (SELECT task, split, max(CASE WHEN model = 'm0' THEN mean_roc END) AS target, max(CASE WHEN model <> 'm0' THEN mean_roc END) AS other FROM summary GROUP BY ALL)
SELECT task, split, {R('target')} AS target_value, {R('other')} AS best_other, {R('target - other')} AS delta FROM o""".lstrip()))
def _(t):
    long = B.summary(t).withColumn("value", c("mean_roc"))
    return rounded(K.best_other(long, ["task", "split"], "m0"), ["task", "split"], ["target_value", "best_other", "delta"])


@query("A37_win_tie_loss", B.with_sql(B.SUMMARY, """
, d AS (SELECT task, split, max(CASE WHEN model = 'm0' THEN mean_roc END) - max(CASE WHEN model = 'm1' THEN mean_roc END) AS roc,
  -(max(CASE WHEN model = 'm0' THEN mean_pr END) - max(CASE WHEN model = 'm1' THEN mean_pr END)) AS pr FROM summary GROUP BY ALL),
l AS (UNPIVOT d ON roc, pr INTO NAME metric VALUE delta)
SELECT metric, CASE WHEN abs(delta) <= 0.005 THEN 'tie' WHEN delta > 0 THEN 'win' ELSE 'loss' END AS status, count(*) AS n FROM l GROUP BY ALL""".lstrip()))
def _(t):
    out = K.win_tie_loss(B.summary(t), ["task", "split"], "m0", "m1", {"roc": "higher", "pr": "lower"})
    return out.groupBy("metric", "status").agg(F.count("*").alias("n"))


@query("A39_metric_lookup", B.with_sql(B.SUMMARY, f"""
SELECT task, model, split, {R('mean_roc')} AS value FROM summary WHERE (task, model, split) IN (('click', 'm0', 'test'), ('view', 'm3', 'hard'))"""))
def _(t):
    long = B.summary(t).select("task", "model", "split", c("mean_roc").alias("value"))
    return rounded(K.lookup_values(long, [("click", "m0", "test"), ("view", "m3", "hard")], ["task", "model", "split"]), ["task", "model", "split"], ["value"])


# A region plays the first task and a segment-like priority the second; each gives one metric row per model.
DUAL_SQL = B.CAND + f""", l AS (SELECT 'p' || (len % 3) AS model, label, score_a AS prob FROM cand), r AS (SELECT 'q' || (len % 2) AS model, label, score_m AS prob FROM cand),
lc AS (SELECT model, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp, count(*) FILTER (label = 0 AND prob < 0.5) AS tn, count(*) FILTER (label = 1 AND prob < 0.5) AS fn FROM l GROUP BY 1),
rc AS (SELECT model, count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp, count(*) FILTER (label = 0 AND prob < 0.5) AS tn, count(*) FILTER (label = 1 AND prob < 0.5) AS fn FROM r GROUP BY 1),
lm AS (SELECT * FROM ({metrics_sql('lc', 'model')}) JOIN ({ranking_sql('l', 'model')}) USING (model)),
rm AS (SELECT * FROM ({metrics_sql('rc', 'model')}) JOIN ({ranking_sql('r', 'model')}) USING (model))"""


def full_metrics(df):
    values = M.threshold_metrics(M.confusion(df, ["model"], c("prob") >= 0.5))
    return values.join(M.ranking_metrics(df, ["model"]).select("model", "roc_auc", "pr_auc"), "model")


def _dual(t):
    cand = B.candidates(t)
    left = cand.select(F.concat(F.lit("p"), (c("len") % 3).cast("string")).alias("model"), "label", c("score_a").alias("prob"))
    right = cand.select(F.concat(F.lit("q"), (c("len") % 2).cast("string")).alias("model"), "label", c("score_m").alias("prob"))
    return K.dual_rows(full_metrics(left), full_metrics(right), "paired")


@query("J08_model_pairs", B.with_sql(DUAL_SQL, f"""
SELECT lm.model || ' + ' || rm.model AS model, {', '.join(f'{R(f"lm.{chr(34)}{m}{chr(34)}")} AS a_{m}, {R(f"rm.{chr(34)}{m}{chr(34)}")} AS b_{m}' for m in K.DUAL_METRICS)} FROM lm CROSS JOIN rm"""))
def _(t):
    return rounded(_dual(t), ["model"], [f"{s}_{m}" for m in K.DUAL_METRICS for s in "ab"])


@query("A27_macro_worst", B.with_sql(DUAL_SQL, f"""
SELECT lm.model || ' + ' || rm.model AS model, {', '.join(f'{R(f"(lm.{chr(34)}{m}{chr(34)} + rm.{chr(34)}{m}{chr(34)}) / 2")} AS macro_{m}' for m in K.DUAL_METRICS)},
  {R('least(lm.roc_auc, rm.roc_auc)')} AS worst_task_roc_auc, {R('least(lm.pr_auc, rm.pr_auc)')} AS worst_task_pr_auc FROM lm CROSS JOIN rm"""))
def _(t):
    return rounded(_dual(t), ["model"], [f"macro_{m}" for m in K.DUAL_METRICS] + ["worst_task_roc_auc", "worst_task_pr_auc"])


@query("A29_set_overlap", """
WITH a AS (SELECT DISTINCT p_partkey AS k FROM part WHERE p_size > 20), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT (SELECT count(*) FROM a) AS size_a, (SELECT count(*) FROM b) AS size_b, (SELECT count(*) FROM a JOIN b USING (k)) AS size_both, (SELECT count(*) FROM (FROM a UNION FROM b)) AS size_any""")
def _(t):
    return K.set_overlap(t.part.where("p_size > 20").select(c("p_partkey").alias("k")), t.lineitem.where("l_quantity > 45").select(c("l_partkey").alias("k")), "k")


@query("A38_mean_importance", f"SELECT l_partkey AS feature, {R('avg(l_extendedprice)')} AS gain FROM lineitem GROUP BY 1")
def _(t):
    gains = t.lineitem.select(c("l_partkey").alias("feature"), c("l_extendedprice").alias("gain"))
    return gains.groupBy("feature").agg(S.r6(F.avg("gain")).alias("gain"))


@query("P20_display_strings", B.with_sql(B.SUMMARY, f"""
SELECT task, model, split, {fixed4_sql('mean_roc')} || ' +/- ' || {fixed4_sql('std_roc')} AS shown, CASE WHEN std_roc < 0.001 THEN '<0.001' ELSE {fixed4_sql('std_roc')} END AS p_text,
  CASE WHEN mean_roc = max(mean_roc) OVER (PARTITION BY task, split) THEN '**' || {fixed4_sql('mean_roc')} || '**' ELSE {fixed4_sql('mean_roc')} END AS marked FROM summary"""))
def _(t):
    marked = K.mark_best(B.summary(t), ["task", "split"], "mean_roc")
    text = S.fixed4(c("mean_roc"))
    return marked.select("task", "model", "split", S.mean_sd_text(c("mean_roc"), c("std_roc")).alias("shown"), S.p_value_text(c("std_roc")).alias("p_text"),
                         F.when(c("is_best"), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text).alias("marked"))


@query("L03_group_selection", B.with_sql(B.SUMMARY, f"""
, s AS (SELECT split AS task, task || model AS feature_group, mean_roc, std_roc, mean_pr FROM summary),
q AS (SELECT task, greatest(0.05, quantile_cont(mean_roc, 0.5)) AS r, greatest(0.1, quantile_cont(mean_pr, 0.5)) AS p FROM s GROUP BY 1),
f AS (SELECT s.*, mean_roc >= r AND mean_pr >= p AND std_roc <= 0.03 AS selected FROM s JOIN q ON q.task = s.task)
SELECT task, feature_group, selected, {R('mean_roc')} AS mean_roc FROM (SELECT *, bool_or(selected) OVER (PARTITION BY feature_group) AS anywhere FROM f) WHERE anywhere""".lstrip()))
def _(t):
    s = B.summary(t).select(c("split").alias("task"), F.concat("task", "model").alias("feature_group"), "mean_roc", "std_roc", "mean_pr")
    return rounded(K.select_groups(s, 0.5, 0.05, 0.1, 0.03), ["task", "feature_group", "selected"], ["mean_roc"])


@query("L05_compact_topk", B.with_sql(B.METRIC_ROWS, f"""
, sw AS (SELECT task, CAST(user_id AS BIGINT) AS k, round(avg(roc) * 1e6) / 1e6 AS roc, round(avg(pr) * 1e6) / 1e6 AS pr FROM metric_rows GROUP BY ALL),
b AS (SELECT task, roc AS broc, pr AS bpr FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY roc DESC, pr DESC) AS i FROM sw) WHERE i = 1),
e AS (SELECT sw.*, row_number() OVER (PARTITION BY sw.task ORDER BY k, roc DESC, pr DESC) AS i FROM sw JOIN b ON b.task = sw.task WHERE roc >= broc - 0.05 AND pr >= bpr - 0.05)
SELECT task, k, roc, pr FROM e WHERE i = 1""".lstrip()))
def _(t):
    sweep = B.metric_rows(t).groupBy("task", c("user_id").alias("k")).agg(S.r6(F.avg("roc")).alias("roc"), S.r6(F.avg("pr")).alias("pr"))
    return K.compact_topk(sweep, 0.05)


FRAMES = "frames AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, user_id % 10 AS residue, event_type, event_id FROM events)"


@query("A33_state_fraction", B.with_sql(FRAMES, f"""
, f AS (SELECT frame, avg((event_type = 'click')::INT) AS fraction FROM frames GROUP BY 1)
SELECT {R('arg_min(fraction, frame)')} AS initial, {R('arg_max(fraction, frame)')} AS final, {R('avg(fraction) FILTER (frame BETWEEN 473400 AND 473600)')} AS window_mean FROM f""".lstrip()))
def _(t):
    from ..operators.frames import fraction_summary, state_fractions

    out = fraction_summary(state_fractions(_frames(t), ["frame"], c("event_type") == "click"), "frame", 473400, 473600)
    return rounded(out, [], ["initial", "final", "window_mean"])


def _frames(t):
    return t.events.select(F.floor(F.unix_timestamp(c("ts").cast("timestamp")) / 3600).cast("long").alias("frame"), (c("user_id") % 10).alias("residue"), "event_type", "event_id")


@query("A33_state_matrix", B.with_sql(FRAMES, f"""
, coded AS (SELECT *, CASE event_type WHEN 'click' THEN 'H' WHEN 'view' THEN 'E' ELSE 'C' END AS state FROM frames)
SELECT frame, {', '.join(f"coalesce(arg_max(state, event_id) FILTER (residue = {i}), '') AS r{i}" for i in range(10))} FROM coded GROUP BY 1""".lstrip()))
def _(t):
    from ..operators.frames import state_matrix

    state = F.when(c("event_type") == "click", "H").when(c("event_type") == "view", "E").otherwise("C")
    wide = state_matrix(_frames(t), "frame", "residue", state, list(range(10)), c("event_id"))
    return wide.select("frame", *[F.coalesce(f"`{i}`", F.lit("")).alias(f"r{i}") for i in range(10)])


@query("K07_figure_source", B.with_sql(B.SUMMARY, f"""
SELECT task, model, split, metric, {R('value')} AS value FROM (UNPIVOT (SELECT task, model, split, mean_roc, std_roc, mean_pr, std_pr FROM summary) ON mean_roc, std_roc, mean_pr, std_pr INTO NAME metric VALUE value)"""))
def _(t):
    from ..sources.sinks import source_table

    long = source_table(B.summary(t).select("task", "model", "split", *SUMMARY_VALUES), ["task", "model", "split"], SUMMARY_VALUES)
    return rounded(long, ["task", "model", "split", "metric"], ["value"])
