"""Significance job: one target model against two comparators on two tasks, one query per table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metrics import THRESHOLD_METRICS as TM
from ..operators.significance import Comparison
from . import base as B
from .metric_queries import CUTS, N_BOOT, N_SWAPS, SEED, R, metrics_sql, rounded
from .registry import query

c = F.col


def _comparison(t) -> Comparison:
    task = F.when(c("qc_pass"), "open").otherwise("closed")
    rows = B.candidates(t).select(task.alias("task"), "cand_id", "label", "score_a", "score_m", "score_b")
    return Comparison(rows, ["task"], "cand_id", {"a": "score_a", "m": "score_m", "b": "score_b"}, 0.5, N_BOOT, SEED)


# --- SQL: row counts, weights and swaps per joint cell ---------------------------------------------

CELL = "task, label, ha, hm, hb"
UNPIVOTED = ", ".join(f'"{m}"' for m in TM)


def conf_sql(source: str, keys: str) -> str:
    side = lambda name, cond: f"coalesce(sum(w) FILTER ({cond}), 0) AS {name}"
    return (f"SELECT {keys}, {side('tp', 'label = 1 AND hit')}, {side('fp', 'label = 0 AND hit')}, "
            f"{side('tn', 'label = 0 AND NOT hit')}, {side('fn', 'label = 1 AND NOT hit')} FROM {source} GROUP BY ALL")


JOINT = B.CAND + f""",
wide AS MATERIALIZED (SELECT CASE WHEN qc_pass THEN 'open' ELSE 'closed' END AS task, cand_id, label, score_a >= 0.5 AS ha, score_m >= 0.5 AS hm, score_b >= 0.5 AS hb FROM cand),
cells AS MATERIALIZED (SELECT {CELL}, count(*) AS w FROM wide GROUP BY ALL)"""

BOOT = f""",
bh AS (SELECT {CELL}, b, md5(concat_ws('|', '{SEED}', 'boot', cand_id, CAST(b AS VARCHAR))) AS h FROM wide, (SELECT unnest(range(0, {(N_BOOT - 1) // 8 + 1})) AS b)),
bl AS (SELECT {CELL}, b * 8 + i AS replicate, substr(h, CAST(4 * i + 1 AS INT), 4) AS p FROM bh, (SELECT unnest(range(0, 8)) AS i)),
bw AS MATERIALIZED (SELECT {CELL}, replicate, sum({' + '.join(f"(p >= '{cut}')::INT" for cut in CUTS)}) AS w FROM bl WHERE replicate < {N_BOOT} GROUP BY ALL
  UNION ALL SELECT {CELL}, -1, w FROM cells),
blong AS ({' UNION ALL '.join(f"SELECT task, replicate, '{m}' AS model, label, h{m} AS hit, w FROM bw" for m in 'amb')}),
bconf AS ({conf_sql('blong', 'task, replicate, model')}),
bmet AS (SELECT * FROM ({metrics_sql('bconf', 'task, replicate, model')})),
val AS MATERIALIZED (UNPIVOT bmet ON {UNPIVOTED} INTO NAME metric VALUE value)"""

PAIRS = f""",
pair AS (SELECT x.task, x.replicate, x.metric, y.model AS comparator, x.value AS tv, y.value AS cv, x.value - y.value AS delta
  FROM val x JOIN val y ON x.task = y.task AND x.replicate = y.replicate AND x.metric = y.metric WHERE x.model = 'a' AND y.model <> 'a'),
seen AS (SELECT * FROM pair WHERE replicate = -1),
drawn AS (SELECT task, comparator, metric, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high, count(*) FILTER (delta <= 0) AS lost, count(*) AS n
  FROM pair WHERE replicate >= 0 GROUP BY ALL),
sh AS (SELECT {CELL}, b, md5(concat_ws('|', '{SEED}', 'swap', cand_id, CAST(b AS VARCHAR))) AS h FROM wide, (SELECT unnest(range(0, {(N_SWAPS - 1) // 32 + 1})) AS b)),
sw AS MATERIALIZED (SELECT {CELL}, b * 32 + i AS replicate, substr(h, CAST(i + 1 AS INT), 1) >= '8' AS s, count(*) AS w
  FROM sh, (SELECT unnest(range(0, 32)) AS i) WHERE b * 32 + i < {N_SWAPS} GROUP BY ALL),
slong AS ({' UNION ALL '.join(f"SELECT task, replicate, '{m}' AS comparator, 'x' AS side, label, CASE WHEN s THEN h{m} ELSE ha END AS hit, w FROM sw UNION ALL SELECT task, replicate, '{m}', 'y', label, CASE WHEN s THEN ha ELSE h{m} END, w FROM sw" for m in 'mb')}),
sconf AS ({conf_sql('slong', 'task, replicate, comparator, side')}),
smet AS (SELECT * FROM ({metrics_sql('sconf', 'task, replicate, comparator, side')})),
sval AS (UNPIVOT smet ON {UNPIVOTED} INTO NAME metric VALUE value),
sdelta AS (SELECT task, replicate, comparator, metric, max(CASE WHEN side = 'x' THEN value END) - max(CASE WHEN side = 'y' THEN value END) AS delta FROM sval GROUP BY ALL),
swaps AS (SELECT d.task, d.comparator, d.metric, count(*) FILTER (d.delta >= seen.delta - 1e-12) AS above, count(*) AS n
  FROM sdelta d JOIN seen ON d.task = seen.task AND d.comparator = seen.comparator AND d.metric = seen.metric GROUP BY ALL),
full_table AS (SELECT seen.task, seen.comparator, seen.metric, {R('tv')} AS target_value, {R('cv')} AS comparator_value, {R('delta')} AS delta, {R('low')} AS low, {R('high')} AS high,
  {R('CASE WHEN delta <= 0 THEN 1.0 ELSE (lost + 1) / (drawn.n + 1) END')} AS bootstrap_p, {R('CASE WHEN delta <= 0 THEN 1.0 ELSE (above + 1) / (swaps.n + 1) END')} AS permutation_p
  FROM seen JOIN drawn ON seen.task = drawn.task AND seen.comparator = drawn.comparator AND seen.metric = drawn.metric
  JOIN swaps ON seen.task = swaps.task AND seen.comparator = swaps.comparator AND seen.metric = swaps.metric)"""

VALUES = ["target_value", "comparator_value", "delta", "low", "high", "bootstrap_p", "permutation_p"]
KEYS = ["task", "comparator", "metric"]


@query("Y13_model_intervals", B.with_sql(JOINT + BOOT, f"""
SELECT task, model, metric, {R('max(value) FILTER (replicate = -1)')} AS value, {R('quantile_cont(value, 0.025) FILTER (replicate >= 0)')} AS low,
  {R('quantile_cont(value, 0.975) FILTER (replicate >= 0)')} AS high FROM val GROUP BY ALL"""))
def _(t):
    return rounded(_comparison(t).intervals(), ["task", "model", "metric"], ["value", "low", "high"])


@query("Y13_comparisons", B.with_sql(JOINT + BOOT + PAIRS, f"SELECT {', '.join(KEYS + VALUES)} FROM full_table"))
def _(t):
    return rounded(_comparison(t).comparisons(), KEYS, VALUES)


@query("Y13_best_comparisons", B.with_sql(JOINT + BOOT + PAIRS + """,
best AS (SELECT task, metric, comparator FROM (SELECT *, row_number() OVER (PARTITION BY task, metric ORDER BY cv DESC, comparator DESC) AS i FROM seen) WHERE i = 1)""",
    f"SELECT {', '.join(f'f.{k}' for k in KEYS + VALUES)} FROM full_table f JOIN best ON f.task = best.task AND f.metric = best.metric AND f.comparator = best.comparator"))
def _(t):
    return rounded(_comparison(t).best_comparisons(), KEYS, VALUES)


@query("Y13_mcnemar", B.with_sql(JOINT + f""",
k AS (SELECT task, comparator, sum(w) FILTER (ok AND NOT other) AS a_only, sum(w) FILTER (other AND NOT ok) AS b_only FROM (
  SELECT task, 'm' AS comparator, ha = (label = 1) AS ok, hm = (label = 1) AS other, w FROM cells UNION ALL SELECT task, 'b', ha = (label = 1), hb = (label = 1), w FROM cells) GROUP BY ALL),
term AS (SELECT *, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) AS p FROM (
  SELECT task, comparator, CAST(a_only AS BIGINT) AS a_only, CAST(b_only AS BIGINT) AS b_only, CAST(a_only + b_only AS BIGINT) AS n,
         unnest(range(CAST(a_only AS BIGINT), CAST(a_only + b_only AS BIGINT) + 1)) AS i FROM k))""",
    f"SELECT task, comparator, a_only, b_only, {R('CASE WHEN a_only = 0 THEN 1.0 ELSE least(1.0, sum(p)) END')} AS p_value FROM term GROUP BY task, comparator, a_only, b_only"))
def _(t):
    return rounded(_comparison(t).mcnemar(), ["task", "comparator", "a_only", "b_only"], ["p_value"])
