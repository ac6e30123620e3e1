"""Sinks: CSV, FASTA, split bundles, parquet, JSON manifests and long source tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import is_standard


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def composed_header(label: str = "label", sources: str = "source_dbs", splits: str = "source_splits", key: str = "fasta_id") -> Column:
    text = lambda name, value: F.concat(F.lit(f"{name}="), F.col(value).cast("string"))
    return F.concat_ws("|", F.col(key), text("label", label), text("sources", sources), text("splits", splits), text("length", "length"))


def write_fasta(df: DataFrame, path: str, header: Column, sequence: str = "sequence", strict: bool = False,
                compression: str = "none") -> None:
    """``>header`` and sequence lines, plain or gzip; the strict form refuses non-standard letters."""
    seq = F.col(sequence)
    if strict:
        refuse = F.raise_error(F.concat(F.lit("non-standard sequence: "), seq)).cast("string")
        seq = F.when(is_standard(seq), seq).otherwise(refuse)
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), seq).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_split_bundle(df: DataFrame, path: str, split: str = "split", key: str = "fasta_id") -> None:
    """One folder per split, as CSV and as FASTA."""
    df.write.mode("overwrite").option("header", True).partitionBy(split).csv(f"{path}/csv")
    entry = F.concat(F.lit(">"), F.col(key), F.lit("\n"), F.col("sequence")).alias("value")
    df.select(entry, split).write.mode("overwrite").partitionBy(split).text(f"{path}/fasta")


def write_clusters(df: DataFrame, path: str, cluster: str, member: str, length: str) -> None:
    """``>Cluster n`` and one numbered line per member, the first one marked. A cluster stays in one file.

    Members are numbered by a window that streams over sorted rows, so a huge cluster spills but is never held.
    """
    number = F.row_number().over(Window.partitionBy(cluster).orderBy(member)) - 1
    entry = F.concat(F.lit("\t"), F.col(length).cast("string"), F.lit("aa, >"), F.col(member), F.lit("..."))
    line = F.concat(F.col("_no").cast("string"), entry, F.when(F.col("_no") == 0, F.lit(" *")).otherwise(F.lit("")))
    head = F.concat(F.lit(">Cluster "), F.col(cluster).cast("string"), F.lit("\n"))
    value = F.when(F.col("_no") == 0, F.concat(head, line)).otherwise(line)
    df.withColumn("_no", number).select(value.alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """A bounded summary as JSON; structs stay nested."""
    df.coalesce(1).write.mode("overwrite").json(path)


def feature_bundle(splits: Sequence[DataFrame], meta: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Metadata and selected features of every (task, split) in one table."""
    parts = [df.select("task", "split", *meta, *features) for df in splits]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_feature_bundle(splits: Sequence[DataFrame], meta: Sequence[str], features: Sequence[str], path: str) -> None:
    write_table(feature_bundle(splits, meta, features), path, ["task", "split"])


def source_table(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value) of a wide metric table."""
    return df.unpivot(list(keys), list(values), "metric", "value")
