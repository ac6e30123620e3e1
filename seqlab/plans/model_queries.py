"""Model queries (rows-only checks: tree ensembles and solvers have no SQL form) and composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import descriptors as D, scalars as S
from ..operators import boosting as BO, comparison as K, matching as MT, metrics as M, models as ML, ranking as RK, record_vectors as RV, shortcuts as SC, similarity as SIM
from ..session import materialise
from . import base as B, jobs
from .matching_queries import EXACT, LIBRARY, recursive
from .metric_queries import DELTAS, fixed4_sql, full_metrics, metrics_sql, ranking_sql
from .registry import query

c = F.col
SEEDS = (7, 13, 29, 42, 101)
R = B.r6_sql
EMB = [f"e{i}" for i in range(64)]


def _emb(t, task="upper"):
    """Embedding rows as a binary task: classes 5-9 against 0-4, or odd against even classes."""
    yes = c("label") >= 5 if task == "upper" else c("label") % 2 == 1
    df = t.embeddings.select("vec_id", "embedding", F.when(yes, 1).otherwise(0).alias("label"))
    return ML.hashed_split(df, "vec_id", 42).withColumn("features", c("embedding"))


def _fitted(df, jobs, seeds=SEEDS):
    """Models of a grid, stored in the shared folder and read back: later steps never fit again."""
    models = BO.fit_ensembles(df.where("split = 'train'"), jobs, seeds)
    return BO.load(df.sparkSession, BO.store(models))


@query("L01_tree_ensemble")
def _(t):
    data = _emb(t)
    models = _fitted(data, {"all": range(64)})
    return ML.evaluate(BO.score(data.where("split <> 'train'"), models, ["split", "label"]), ["seed", "split"])


def _grid(data, jobs):
    scored = materialise(BO.score(data.where("split <> 'train'"), _fitted(data, jobs), ["split", "label"]).withColumnRenamed("name", "feature_group"))
    return K.seed_summary(ML.evaluate(scored, ["feature_group", "seed", "split"]), ["feature_group", "split"], ["roc_auc", "pr_auc"])


@query("L02_screening_grid")
def _(t):
    tasks = [_grid(_emb(t, task), {"first": range(32), "second": range(32, 64)}).withColumn("task", F.lit(task)) for task in ("upper", "odd")]
    return tasks[0].unionByName(tasks[1]).orderBy("task", "split", c("mean_roc_auc").desc())


@query("L04_gain_importance")
def _(t):
    gains = BO.gains(_fitted(_emb(t), {"all": range(64)}), EMB)
    return gains.groupBy("feature").agg(F.avg("gain").alias("gain"))


def _ranked(gains):
    """Feature positions by mean gain; as many as there are features."""
    means = gains.groupBy("feature").agg(F.avg("gain").alias("gain")).orderBy(c("gain").desc(), "feature").collect()
    return [int(r["feature"][1:]) for r in means]


@query("L05_topk_sweep")
def _(t):
    data = _emb(t)
    ranked = _ranked(BO.gains(_fitted(data, {"all": range(64)}), EMB))
    models = _fitted(data, {f"{k:03d}": ranked[:k] for k in (4, 8, 16, 32, 48, 64)}, SEEDS[:1])
    scored = BO.score(data.where("split = 'val'"), models, ["label"]).withColumn("k", c("name").cast("int"))
    sweep = ML.evaluate(scored, ["k"]).select("k", c("roc_auc").alias("roc"), c("pr_auc").alias("pr"))
    return K.compact_topk(sweep.withColumn("task", F.lit("emb")), 0.01)


@query("L06_shared_union")
def _(t):
    data = _emb(t)
    top = None
    for task in ("upper", "odd"):
        gains = BO.gains(_fitted(_emb(t, task), {task: range(64)}), EMB)
        part = RK.top_per_group(gains.withColumn("task", F.concat_ws("|", "name", c("seed").cast("string"))), ["task"], [c("gain").desc(), c("feature").asc()], 16)
        top = part if top is None else top.unionByName(part)
    chosen = sorted(int(r["feature"][1:]) for r in top.select("feature").distinct().collect())  # at most one row per feature
    return ML.evaluate(BO.score(data.where("split <> 'train'"), _fitted(data, {"union": chosen}), ["split", "label"]), ["seed", "split"])


@query("L07_shortcut_balanced_branch")
def _(t):
    rows = SC.with_shortcut_columns(B.unique_rows(t, "toxic")).withColumn("label", S.label_id(c("label")))
    balanced = ML.hashed_split(MT.balance_classes(rows, ["starts_m"], 42, "uid", "label"), "uid", 42)
    phys = [f"phys8_{n}" for n in D.PHYS8]
    feats = materialise(RV.with_phys8(balanced, "sequence").select("split", "label", F.array(*D.aac(c("sequence")), *phys).alias("features")))
    names = [f"AAC_{r}" for r in S.RESIDUES] + phys
    gains = BO.gains(_fitted(feats, {"all": range(len(names))}), names)
    return gains.groupBy("feature").agg(F.avg("gain").alias("gain")).orderBy(c("gain").desc(), "feature").limit(512)


@query("L08_modality_grid")
def _(t):
    names = [f"phys8_{n}" for n in D.PHYS8]
    docs = RV.with_phys8(B.records(t), "sequence").groupBy("doc_id").agg(*[F.avg(n).alias(n) for n in names])
    phys = docs.select(c("doc_id").alias("vec_id"), F.array(*names).alias("phys"))
    joined = _emb(t).join(phys, "vec_id").withColumn("features", F.concat("phys", c("embedding").cast("array<double>")))
    joined = materialise(joined.select("vec_id", "label", "split", "features"))  # counted, fitted and scored
    return _grid(joined, {"descriptors": range(8), "embedding": range(8, 72), "both": range(72)})


@query("L10_linear_probe")
def _(t):
    out = ML.linear_probe(ML.from_array(_emb(t), "embedding"), "vec_id", 42)
    return M.ranking_metrics(out, [], bounds=())


@query("L11_projection")
def _(t):
    return ML.project_2d(ML.from_array(_emb(t), "embedding"), "vec_id")


@query("L12_perceptron")
def _(t):
    data = ML.from_array(_emb(t), "embedding").cache()
    model = ML.perceptron(7, 64).fit(data.where("split = 'train'"))
    return ML.evaluate(ML.predict(model, data.where("split <> 'train'"), ["split", "label"]), ["split"])


@query("L13_ensemble_scoring")
def _(t):
    data = _emb(t)
    stored = BO.store(BO.fit_ensembles(data.where("split = 'train'"), {"all": range(64)}, SEEDS))
    long = BO.score(data.where("split <> 'train'"), BO.load(t.spark, stored), ["vec_id"])
    return M.seed_ensemble(long, ["vec_id"], "seed", SEEDS)


_NUMBERED = """'seq_' || lpad(CAST(row_number() OVER (ORDER BY CASE WHEN label = 'positive' THEN 0 ELSE 1 END, sequence) AS VARCHAR), 6, '0') AS fasta_id"""


def _cells(model: str, score: str) -> str:
    return (f"SELECT '{model}' AS model, count(*) FILTER (label = 1 AND {score} >= 0.5) AS tp, count(*) FILTER (label = 0 AND {score} >= 0.5) AS fp, "
            f"count(*) FILTER (label = 0 AND {score} < 0.5) AS tn, count(*) FILTER (label = 1 AND {score} < 0.5) AS fn FROM cand")


_PAIRED = B.CAND + f""", conf AS ({_cells('a', 'score_a')} UNION ALL {_cells('m', 'score_m')}),
long AS (SELECT 'a' AS model, label, score_a AS prob FROM cand UNION ALL SELECT 'm', label, score_m FROM cand),
v AS MATERIALIZED (SELECT * FROM ({metrics_sql('conf', 'model')}) JOIN ({ranking_sql('long', 'model')}) USING (model)),
l AS (SELECT CASE WHEN model = 'a' THEN 'a1' ELSE 'a2' END AS name, * FROM v), r AS (SELECT CASE WHEN model = 'm' THEN 'b1' ELSE 'b2' END AS name, * FROM v)
SELECT l.name || ' + ' || r.name AS model, 'paired' AS category, {', '.join(f'{R(f"(l.{chr(34)}{m}{chr(34)} + r.{chr(34)}{m}{chr(34)}) / 2")} AS macro_{m}' for m in K.DUAL_METRICS)} FROM l CROSS JOIN r"""


# --- composite jobs ------------------------------------------------------------------------------------

@query("Y01_benchmark_build", B.with_sql(B.UNIQ, """
SELECT 'seq_' || lpad(CAST(row_number() OVER (ORDER BY CASE WHEN label = 'positive' THEN 0 ELSE 1 END, sequence) AS VARCHAR), 6, '0') AS fasta_id,
  sequence, support_count, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS label_id FROM uniq"""))
def _(t):
    return jobs.build_benchmark(B.labelled(t), jobs.Policy()).select("fasta_id", "sequence", "support_count", "label_id")


@query("Y02_policy_build")
def _(t):
    built = jobs.build_benchmark(B.labelled(t), jobs.Policy(sources=("src0", "src1", "src2", "src3")))
    clusters = built.join(SIM.similarity_clusters(built), "sequence").select("fasta_id", "cluster_id")
    return MT.split_summary(jobs.split_benchmark(built, clusters), "cluster_id", c("label") == "positive")


@query("Y03_matched_release", recursive(LIBRARY, f"""
SELECT {_NUMBERED}, sequence, label, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS label_id FROM (
  SELECT sequence, label FROM uniq WHERE label = 'positive' UNION ALL SELECT sequence, label FROM drawn)"""))
def _(t):
    built = jobs.build_benchmark(B.labelled(t, "toxic"), jobs.Policy(matching="library"))
    return built.select("fasta_id", "sequence", "label", "label_id")


@query("Y04_second_task", B.with_sql(EXACT, f"""
SELECT {_NUMBERED}, sequence, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS label_id, CASE WHEN label = 'positive' THEN 'toxic' ELSE 'non_toxic' END AS task_label FROM (
  SELECT sequence, label FROM uniq WHERE label = 'positive' UNION ALL SELECT sequence, label FROM drawn WHERE rn <= quota)"""))
def _(t):
    built = jobs.build_benchmark(B.labelled(t, "toxic"), jobs.Policy(matching="exact", preferred=("src1", "src2")))
    return built.select("fasta_id", "sequence", "label_id", S.label_name(c("label_id"), "toxic", "non_toxic").alias("task_label"))


@query("Y05_hard_tests")
def _(t):
    rows = B.unique_rows(t, "toxic").withColumn("label_id", S.label_id(c("label")))
    first, second = jobs.hard_tests(rows, 42, "uid")
    keep = lambda df, name: df.select("uid", "label_id", F.lit(name).alias("hard_set"))
    return keep(first, "first_residue").unionByName(keep(second, "frequency_bins"))


@query("Y06_feature_export", B.with_sql(B.RECORDS, f"""
SELECT record_id, {R(B.count_sql('sequence', 'A') + ' / length')} AS aac_a, {R(B.count_sql('sequence', 'KRH') + ' / length')} AS gaac_p, {R('length / 100.0')} AS length_norm FROM records"""))
def _(t):
    out = jobs.feature_export(B.records(t), "record_id")
    return out.select("record_id", S.r6(c("AAC_A")).alias("aac_a"), S.r6(c("GAAC_p")).alias("gaac_p"), S.r6(c("phys8_length_norm")).alias("length_norm"))


@query("Y11_paired_comparison", B.with_sql(_PAIRED.rsplit("\nSELECT", 1)[0], "SELECT" + _PAIRED.rsplit("\nSELECT", 1)[1]))
def _(t):
    cand = B.candidates(t)
    side = lambda name, score, label: cand.select(F.lit(name).alias("model"), c(label).alias("label"), c(score).alias("prob"))
    left = side("a1", "score_a", "label").unionByName(side("a2", "score_m", "label"))
    right = side("b1", "score_m", "label").unionByName(side("b2", "score_a", "label"))
    paired = K.dual_rows(full_metrics(left), full_metrics(right), "paired")
    ordered = paired.orderBy(c("macro_roc_auc").desc(), c("macro_pr_auc").desc(), "model")
    return ordered.select("model", "category", *[S.r6(c(f"macro_{m}")).alias(f"macro_{m}") for m in K.DUAL_METRICS])


@query("Y12_evidence_package", B.with_sql(DELTAS, f"""
, means AS (SELECT task, model, split, avg(roc) AS roc, avg(pr) AS pr FROM results GROUP BY ALL),
g AS (SELECT task, split, max(CASE WHEN model = 'm0' THEN roc END) - max(CASE WHEN model = 'm1' THEN roc END) AS roc, max(CASE WHEN model = 'm0' THEN pr END) - max(CASE WHEN model = 'm1' THEN pr END) AS pr FROM means GROUP BY ALL),
pg AS (SELECT task, split, metric FROM (UNPIVOT g ON roc, pr INTO NAME metric VALUE gain) WHERE gain > 0.0005)
SELECT s.task, s.split, s.metric, {fixed4_sql('mean_delta', True)} AS mean_delta, seeds_improved || '/' || seeds_total AS seed_wins, seed_deltas,
  mean_delta > 0.0005 AND seeds_improved >= 2 AS key_gain, pg.task IS NOT NULL AS positive_gain
FROM stats s LEFT JOIN pg ON pg.task = s.task AND pg.split = s.split AND pg.metric = s.metric""".lstrip()))
def _(t):
    tables = jobs.evidence_tables(B.results(t), "m0", "m1", ["roc", "pr"])
    keys = ["task", "split", "metric"]
    mark = lambda name, flag: tables[name].select(*keys, F.lit(True).alias(flag))
    joined = tables["deltas"].join(mark("key_gains", "key_gain"), keys, "left").join(mark("positive_gains", "positive_gain"), keys, "left")
    flat = joined.na.fill({"key_gain": False, "positive_gain": False})
    wins = F.concat_ws("/", c("seeds_improved").cast("string"), c("seeds_total").cast("string"))
    return flat.select(*keys, S.fixed4(c("mean_delta"), signed=True).alias("mean_delta"), wins.alias("seed_wins"), "seed_deltas", "key_gain", "positive_gain")
