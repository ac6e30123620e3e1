"""Audit, deduplication, conflicts, keep-first and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


# --- audit ----------------------------------------------------------------------------------

def charge_first_failure(df: DataFrame, rules: Sequence[tuple[str, Column]], column: str = "outcome") -> DataFrame:
    """Charge each row to its first failing rule, or to ``kept_rows``.

    ``rules`` are (name, condition-for-skipping) in order. One narrow projection.
    """
    outcome = F.lit(None).cast("string")
    for name, failing in reversed(list(rules)):
        outcome = F.when(failing, F.lit(name)).otherwise(outcome)
    return df.withColumn(column, F.coalesce(outcome, F.lit("kept_rows")))


def audit_report(charged: DataFrame, by: Sequence[str], column: str = "outcome") -> DataFrame:
    return charged.groupBy(*by, column).agg(F.count("*").alias("rows"))


# --- duplicates and conflicts ---------------------------------------------------------------

def deduplicate(records: DataFrame, position: Sequence[str] = ("doc_id", "frag_no")) -> DataFrame:
    """One row per (sequence, label).

    Everything here combines map-side, and every collected set is bounded by the number of
    sources, so a sequence that holds a third of all rows is no hot spot. The member ids are
    not collected: they stay rows, see ``lineage``.
    """
    name = F.when(F.col("record_name") != "", F.col("record_name"))
    order = F.when(F.col("record_name") != "", F.struct(*position))
    mark = F.when(F.col("raw_label") != "", F.col("raw_label"))
    return records.groupBy("sequence", "label").agg(
        F.count("*").alias("support_count"),
        F.array_sort(F.collect_set("source_db")).alias("source_dbs"),
        F.array_sort(F.collect_set("source_split")).alias("source_splits"),
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
        F.array_sort(F.collect_set(mark)).alias("raw_labels"),
        F.coalesce(F.min_by(name, order), F.lit("")).alias("example_name"),
    ).withColumn("length", F.length("sequence").cast("long"))


def lineage(records: DataFrame) -> DataFrame:
    """The members behind every deduplicated row, as rows instead of one joined string."""
    return records.where("record_id <> ''").select("sequence", "label", "record_id", "doc_id", "frag_no")


def conflict_report(records: DataFrame) -> DataFrame:
    """Sequences that carry more than one label."""
    tag = F.concat_ws(":", "source_db", "source_split")
    groups = records.groupBy("sequence").agg(
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.array_sort(F.collect_set(tag)).alias("sources"),
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
        F.count("*").alias("n_records"),
    )
    return groups.where(F.size("labels") > 1).withColumn("length", F.length("sequence").cast("long"))


def drop_conflicting_records(records: DataFrame) -> DataFrame:
    """Remove every record of a conflicting sequence (anti join against the small conflict set)."""
    conflicts = (
        records.groupBy("sequence")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("lo <> hi").select("sequence")
    )
    return records.join(conflicts, "sequence", "left_anti")


def conflict_free(unique: DataFrame) -> DataFrame:
    """Conflict filter on deduplicated rows: at most one row per label, so no group is hot."""
    from pyspark.sql import Window

    per_sequence = Window.partitionBy("sequence")
    return unique.withColumn("_n", F.count("*").over(per_sequence)).where("_n = 1").drop("_n")


def dataset_summary(unique: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    positives = F.count_if(F.col("label") == "positive")
    negatives = F.count_if(F.col("label") == "negative")
    return unique.groupBy(*by).agg(
        F.count("*").alias("unique_sequences"),
        positives.alias("positive_unique"),
        negatives.alias("negative_unique"),
        F.coalesce(F.sum("support_count"), F.lit(0)).alias("support_sum"),
        (F.coalesce(F.sum("support_count"), F.lit(0)) - F.count("*")).alias("duplicate_records_collapsed"),
        F.when(positives > 0, F.round(negatives / positives * 1e6) / 1e6).alias("negative_to_positive_ratio"),
    )


def keep_first(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """First row per key by an explicit position; combines map-side unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*position)).alias("_row"))
    return picked.select(*keys, "_row.*")


# --- integrity ------------------------------------------------------------------------------

def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def ambiguous_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that carry several values; min and max suffice and combine map-side."""
    return (
        df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("n"))
        .where("_lo <> _hi").select(key, "n")
    )


def require_empty(df: DataFrame, message: str) -> None:
    """Fail fast when an integrity check finds rows; only a handful reach the driver."""
    bad = df.take(5)
    if bad:
        raise ValueError(f"{message}: {bad}")


def left_join_complete(left: DataFrame, right: DataFrame, on: Sequence[str] | str, probe: str) -> DataFrame:
    """Left join whose right side must cover every row; a hole raises inside the job."""
    joined = left.join(right, on, "left")
    message = F.concat(F.lit(f"missing {probe} after join for "), F.to_json(F.struct(*[on] if isinstance(on, str) else list(on))))
    checked = F.when(F.col(probe).isNull(), F.raise_error(message).cast(right.schema[probe].dataType)).otherwise(F.col(probe))
    return joined.withColumn(probe, checked)


def new_columns_join(left: DataFrame, scores: DataFrame, key: str, never: Sequence[str] = ("sequence",)) -> DataFrame:
    """Left join that brings only the columns not already present."""
    extra = [c for c in scores.columns if c != key and c not in never and c not in left.columns]
    return left.join(scores.select(key, *extra), key, "left")


def suffixed_join(left: DataFrame, right: DataFrame, key: str, suffix: str, right_key: str | None = None) -> DataFrame:
    """Inner join on one id; the right id may have another name, clashing columns get a suffix."""
    if right_key and right_key != key:
        right = right.withColumnRenamed(right_key, key)
    for name in right.columns:
        if name != key and name in left.columns:
            right = right.withColumnRenamed(name, name + suffix)
    return left.join(right, key)


def misaligned_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids present on one side only."""
    joined = a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full_outer")
    return joined.where("_a IS NULL OR _b IS NULL").select(
        key, F.when(F.col("_a").isNull(), "right_only").otherwise("left_only").alias("side")
    )
