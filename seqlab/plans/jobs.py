"""Composite jobs: curation release, screening, priority selection, feature export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import composition as Q, descriptors as D, scalars as S
from ..operators import comparison as K, curation as C, matching as M, record_vectors as RV, screening as SC
from ..operators.ranking import assign_ids
from ..session import materialise


@dataclass(frozen=True)
class Policy:
    """What a benchmark build does: which sources take part, whether and how lengths are matched."""

    sources: tuple[str, ...] = ()
    matching: str = "none"  # none, exact or library
    preferred: tuple[str, str] = ("", "")
    seed: int = 42


def build_benchmark(records: DataFrame, policy: Policy) -> DataFrame:
    """Source subset, conflict filter, dedup, length matching, ids and label ids."""
    chosen = records.where(F.col("source_db").isin(*policy.sources)) if policy.sources else records
    unique = C.conflict_free(C.deduplicate(chosen)).withColumn("uid", F.md5(F.concat_ws("|", "sequence", "label")))
    unique = materialise(unique)  # read several times below
    if policy.matching == "exact":
        unique = M.length_matched_exact(unique, policy.seed, "uid", S.source_weight(F.col("source_dbs"), *policy.preferred))
    elif policy.matching == "library":
        unique, _, _ = M.length_matched_library(unique, policy.seed, "uid")
    order = [F.when(F.col("label") == "positive", 0).otherwise(1).asc(), F.col("sequence").asc()]
    return assign_ids(unique, order, "seq").withColumn("label_id", S.label_id(F.col("label")))


def split_benchmark(rows: DataFrame, clusters: DataFrame, seed: int = 42) -> DataFrame:
    """Whole clusters to train, val and test; ``clusters`` holds (fasta_id, cluster_id)."""
    return M.cluster_split(M.attach_clusters(rows, clusters, "fasta_id"), "cluster_id", F.col("label") == "positive", seed)


def hard_tests(rows: DataFrame, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The two shortcut-controlled sets: first-residue strata, and the best cysteine-frequency bins."""
    from ..operators.shortcuts import with_shortcut_columns

    table = materialise(with_shortcut_columns(rows))
    first = M.balance_classes(table, ["starts_m"], seed, key)
    candidates = [20, 16, 12, 10, 8, 5]
    matched = materialise(M.bin_matched(table, "c_frequency", candidates, seed, key))
    best = M.best_bins(M.bin_attempts(matched, "c_frequency", candidates), candidates)
    return first, matched.join(F.broadcast(best), "bins")  # the best bin count is one row


def feature_export(rows: DataFrame, key: str, seq: str = "sequence") -> DataFrame:
    """Composition, grouped composition and physico-chemical vectors in one key-joined table.

    The descriptors are computed once per distinct sequence and handed back to every row.
    """
    from ..operators.features import compute_once_and_fan_out

    s = F.col(seq)
    compute = lambda d: RV.with_ctdt(RV.with_phys8(d, seq).select("*", *D.aac(s), *D.grouped_composition(s), *D.ctdc(s)), seq)
    return compute_once_and_fan_out(rows.select(key, seq), seq, compute).drop(seq)


def screen_candidates(candidates: DataFrame, seq: str, scores: DataFrame, score_key: str, key: str, min_a: float, max_b: float) -> DataFrame:
    """Quality vector, scores, desirabilities, decision score and rank. The score is rounded so that
    ranks do not hang on the last bit."""
    joined = C.new_columns_join(Q.with_qc(candidates, seq), scores, score_key)
    scored = SC.decision_columns(joined, "score_a", "score_b", min_a, max_b).withColumn("decision_score", S.r6(F.col("decision_score")))
    return SC.rank_candidates(scored.drop(seq), key)


def priority_summary(candidates: DataFrame, score_a: str, score_b: str, length: str, key: str, n: int) -> DataFrame:
    """Summary of the top n by simple priority, with a bounded top-n instead of a full rank."""
    scored = candidates.withColumn("priority", S.priority_score(F.col(score_a), F.col(score_b)))
    top = scored.where("qc_pass").orderBy(
        F.col("priority").desc(), F.col(score_a).desc(), F.col(score_b).asc(), F.col(length).asc(), F.col(key).asc()).limit(n)
    best = top.agg(
        F.min(score_a).alias("min_a"), F.max(score_b).alias("max_b"), F.min("priority").alias("min_priority"), F.median(length).alias("median_length"))
    totals = scored.agg(F.count("*").alias("n_total"), F.count_if(F.col("qc_pass")).alias("n_qc_pass"))
    return totals.crossJoin(best)  # one row each


def evidence_tables(results: DataFrame, target: str, other: str, metrics: list[str]) -> dict[str, DataFrame]:
    """Evidence package over a results table (task, split, model, seed, metrics): seed summary, paired
    delta statistics, consistent gains and gains of the means."""
    summary = K.seed_summary(results, ["task", "model", "split"], metrics)
    deltas = K.delta_statistics(K.seed_deltas(results, ["task", "split", "seed"], target, other, metrics), ["task", "split", "metric"])
    return {
        "summary": summary,
        "deltas": deltas,
        "key_gains": K.key_gains(deltas),
        "positive_gains": K.positive_gains(K.model_deltas(summary, ["task", "split"], target, other, metrics), ["task", "split"], metrics),
    }
