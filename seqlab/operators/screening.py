"""Candidate pools: assembly, scoring, ranking, shortlists and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S
from .quantiles import exact_quantiles, quantile_columns, with_quantiles
from .ranking import assign_ids, global_position


def assemble_pool(valid: DataFrame, seen: DataFrame, label: str, n: int, lead: tuple[str, str, str] | None = None) -> DataFrame:
    """First ``n`` new distinct sequences in order of ``pos`` with ids, plus an optional lead row."""
    fresh = valid.groupBy("sequence").agg(F.min("pos").alias("pos")).join(seen, "sequence", "left_anti")
    first = fresh.orderBy("pos").limit(n)
    pool = assign_ids(first, [F.col("pos").asc()], label, "candidate_id", 5)
    pool = pool.select("candidate_id", "sequence", F.lit(label).alias("candidate_source"))
    if lead is None:
        return pool
    extra = pool.sparkSession.createDataFrame([lead], ["candidate_id", "sequence", "candidate_source"])
    return pool.unionByName(extra)


def decision_columns(df: DataFrame, score_a: str | None, score_b: str | None, min_a: float, max_b: float) -> DataFrame:
    """Desirabilities, quality and the decision score; quality alone when no scores are given."""
    has_scores = score_a is not None and score_b is not None and {score_a, score_b} <= set(df.columns)
    null = F.lit(None).cast("double")
    good = S.desirability(F.col(score_a), min_a) if has_scores else null
    safe = S.desirability(F.col(score_b), max_b, higher_is_better=False) if has_scores else null
    quality = S.quality_desirability(F.col("qc_pass"), F.col("low_complexity"), F.col("homopolymer"), F.col("gf_rich"))
    out = df.withColumn("desirability", good).withColumn("safety", safe).withColumn("quality", quality)
    decision = S.decision_score(F.col("desirability"), F.col("safety"), F.col("quality")) if has_scores else F.col("quality")
    return out.withColumn("decision_score", decision)


def rank_candidates(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    order = [F.col("decision_score").desc(), F.col("qc_pass").desc(), F.col(key).asc()]
    return global_position(df, order, "rank")


def threshold_shortlist(df: DataFrame, score_a: str, score_b: str, min_a: float, max_b: float, min_decision: float) -> DataFrame:
    keep = F.col("qc_pass")
    if {score_a, score_b} <= set(df.columns):
        keep = keep & (F.col(score_a) >= min_a) & (F.col(score_b) <= max_b) & (F.col("decision_score") >= min_decision)
    return df.where(keep).withColumn("shortlist_scope", F.lit("threshold_rule"))


def lead_scope(ranked: DataFrame, lead_id: str, percentages: Sequence[float], key: str = "candidate_id") -> DataFrame:
    """One row: size, lead rank and percentile, smallest percentage bin that holds the lead, cutoff.

    Without the lead the last bin as given is used; when no bin holds it, its own rank is the cutoff.
    """
    base = ranked.agg(F.count("*").alias("n"), F.max(F.when(F.col(key) == lead_id, F.col("rank"))).alias("lead_rank"))
    cut = lambda pct: F.greatest(F.lit(1), F.ceil(F.col("n") * pct / 100.0)).cast("long")
    bins = F.array(*[F.struct(F.lit(float(p)).alias("pct"), cut(p).alias("cutoff")) for p in sorted(percentages)])
    last = percentages[-1]
    own_pct = 100.0 * F.col("lead_rank") / F.col("n")
    own = F.struct(own_pct.alias("pct"), F.col("lead_rank").cast("long").alias("cutoff"))
    fallback = F.struct(F.lit(float(last)).alias("pct"), cut(last).alias("cutoff"))
    fitting = F.filter(bins, lambda b: F.col("lead_rank") <= b["cutoff"])
    chosen = F.when(F.col("lead_rank").isNull(), fallback).otherwise(F.coalesce(F.get(fitting, F.lit(0)), own))
    return base.withColumn("_c", chosen).select("n", "lead_rank", own_pct.alias("lead_percentile"), "_c.pct", "_c.cutoff")


def adaptive_shortlist(ranked: DataFrame, lead_id: str, percentages: Sequence[float], key: str = "candidate_id") -> DataFrame:
    scope = lead_scope(ranked, lead_id, percentages, key).select("pct", "cutoff")
    text = F.regexp_replace(F.col("pct").cast("string"), r"\.0$", "")
    joined = ranked.join(F.broadcast(scope), F.col("rank") <= F.col("cutoff"))  # the scope is one row
    return joined.withColumn("shortlist_scope", F.concat(F.lit("top_"), text, F.lit("_percent"))).drop("pct", "cutoff")


def priority_ranked(df: DataFrame, score_a: str, score_b: str, length: str, key: str) -> DataFrame:
    """Five-key rank over all rows, and the rank among the rows that pass QC.

    QC is the first sort key, so passing rows lead and both ranks agree on them.
    """
    scored = df.withColumn("priority", S.priority_score(F.col(score_a), F.col(score_b)))
    order = [F.col("qc_pass").desc(), F.col("priority").desc(), F.col(score_a).desc(), F.col(score_b).asc(), F.col(length).asc(), F.col(key).asc()]
    ranked = global_position(scored, order, "rank_all")
    return ranked.withColumn("rank_qc", F.when(F.col("qc_pass"), F.col("rank_all")))


def practical_tier(length: Column, contains_c: Column, m_start: Column) -> Column:
    """1 = strict practical rule, 2 = relaxed rule, 3 = no rule."""
    return (
        F.when(length.between(12, 35) & ~contains_c & ~m_start, 1)
        .when(length.between(10, 40) & ~contains_c, 2)
        .otherwise(3)
    )


def practical_candidates(df: DataFrame, minimum: int = 50) -> DataFrame:
    """Keep the strictest practical rule that leaves ``minimum`` rows; needs length, contains_c, m_start."""
    tier = practical_tier(F.col("length"), F.col("contains_c"), F.col("m_start"))
    tagged = df.withColumn("_tier", tier)
    # Rule 2 covers lengths 10..40, so it contains every row of rule 1.
    counts = tagged.agg(F.count_if(F.col("_tier") == 1).alias("n1"), F.count_if(F.col("_tier") <= 2).alias("n2"))
    limit = F.when(F.col("n1") >= minimum, 1).when(F.col("n2") >= minimum, 2).otherwise(3)
    choice = counts.select(limit.alias("_limit"))
    return tagged.join(F.broadcast(choice), F.col("_tier") <= F.col("_limit")).drop("_tier", "_limit")


def relaxed_top(df: DataFrame, n: int, score_a: str, score_b: str, key: str) -> DataFrame:
    order = [F.col("decision_score").desc(), F.col(score_a).desc(), F.col(score_b).asc(), F.col("length").asc(), F.col(key).asc()]
    return practical_candidates(df, n).orderBy(*order).limit(n)


def tier_columns(df: DataFrame, score_a: str, score_b: str) -> DataFrame:
    flags = [S.tier_flag(F.col("qc_pass"), F.col(score_a), F.col(score_b), lo, hi).alias(name) for name, lo, hi in S.TIERS]
    return df.select("*", *flags)


def pool_summary(df: DataFrame, by: str, score_a: str, score_b: str) -> DataFrame:
    rate = lambda cond: F.avg(cond.cast("int"))
    high, low = F.col(score_a) >= 0.70, F.col(score_b) <= 0.30
    tiers = []
    for name, lo, hi in S.TIERS:
        flag = S.tier_flag(F.col("qc_pass"), F.col(score_a), F.col(score_b), lo, hi)
        tiers += [F.count_if(flag).alias(f"{name}_n"), rate(flag).alias(f"{name}_rate")]
    plain = df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("qc_pass")).alias("qc_pass_n"), rate(F.col("qc_pass")).alias("qc_pass_rate"),
        F.count_if(high).alias("a_ge_0p70_n"), rate(high).alias("a_ge_0p70_rate"),
        F.count_if(low).alias("b_le_0p30_n"), rate(low).alias("b_le_0p30_rate"),
        F.avg(score_a).alias("mean_a"), F.avg(score_b).alias("mean_b"), F.avg("decision_score").alias("mean_decision"), *tiers)
    medians = quantile_columns(
        df, [by], {"median_a": (score_a, 0.5), "median_b": (score_b, 0.5), "median_decision": ("decision_score", 0.5)})
    return with_quantiles(plain, medians, [by])


def tier_enrichment(base: DataFrame, treated: DataFrame, score_a: str, score_b: str) -> DataFrame:
    """Tier rates of two pools side by side. One pass over each pool; the result has one row per tier."""
    tiers = F.array(*[
        F.struct(F.lit(n).alias("tier"), F.lit(lo).alias("min_a"), F.lit(hi).alias("max_b")) for n, lo, hi in S.TIERS])
    counts = []
    for name, lo, hi in S.TIERS:
        counts.append(F.count_if(S.tier_flag(F.col("qc_pass"), F.col(score_a), F.col(score_b), lo, hi)).alias(name))
    tag = base.withColumn("_side", F.lit("base")).unionByName(treated.withColumn("_side", F.lit("treated")), allowMissingColumns=True)
    wide = tag.groupBy("_side").agg(F.count("*").alias("total"), *counts)
    names = [n for n, _, _ in S.TIERS]
    side = lambda which, col: F.max(F.when(F.col("_side") == which, F.col(col)))
    long = wide.unpivot(["_side", "total"], names, "tier", "n")
    out = long.groupBy("tier").agg(
        side("base", "n").alias("base_n"), side("base", "total").alias("base_total"),
        side("treated", "n").alias("treated_n"), side("treated", "total").alias("treated_total"))
    spec = tag.sparkSession.range(1).select(F.explode(tiers).alias("t")).select("t.*")
    out = out.join(F.broadcast(spec), "tier")
    base_rate, treated_rate = F.col("base_n") / F.col("base_total"), F.col("treated_n") / F.col("treated_total")
    return out.select(
        "*", base_rate.alias("base_rate"), treated_rate.alias("treated_rate"), (treated_rate - base_rate).alias("rate_delta"),
        F.when(base_rate > 0, treated_rate / base_rate).otherwise(F.lit(float("inf"))).alias("fold_enrichment"))


def qc_summary(df: DataFrame, shortlist: Column, source: str, score_a: str, score_b: str) -> DataFrame:
    """Rows for all candidates, for the shortlist and for each source from one pass over the table."""
    sets = F.array_compact(F.array(
        F.lit("all_candidates"), F.when(shortlist, F.lit("shortlist")), F.concat(F.lit("source:"), F.col(source))))
    rate = lambda k: F.avg(F.col(k).cast("int")).alias(f"{k}_rate")
    return df.select("*", F.explode(sets).alias("set")).groupBy("set").agg(
        F.count("*").alias("n"), F.avg(score_a).alias("mean_a"), F.avg(score_b).alias("mean_b"),
        F.avg("decision_score").alias("mean_decision"), rate("qc_pass"), rate("low_complexity"), rate("homopolymer"), rate("gf_rich"))


def quantile_table(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles, long form; one row per column and point, null for a column without values."""
    grid = F.explode(F.array(*[F.lit(k) for k in columns])).alias("metric")
    every = df.sparkSession.range(len(points)).select(F.col("id").cast("int").alias("i"), grid)
    found = every.join(exact_quantiles(df, [], columns, points), ["metric", "i"], "left")
    return found.select(
        "metric", F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("i") + 1).alias("quantile"), "value")


def validation_set(df: DataFrame, lead_id: str, score_a: str, score_b: str, key: str = "candidate_id") -> DataFrame:
    """Stringent-tier rows plus the lead, each with the route that selected it. A single scan."""
    _, lo, hi = S.TIERS[1]
    strict = S.tier_flag(F.col("qc_pass"), F.col(score_a), F.col(score_b), lo, hi)
    is_lead = F.col(key) == lead_id
    route = (
        F.when(strict & is_lead, "model_pass_and_prior_lead")
        .when(strict, "model_stringent_threshold_pass")
        .when(is_lead, "prior_lead_reference_flagged")
    )
    return df.withColumn("selection_route", route).where("selection_route IS NOT NULL")
