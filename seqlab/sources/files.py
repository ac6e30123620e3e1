"""File and table sources. Every reader is a lazy Spark scan that keeps the file name as lineage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as S
from ..operators.curation import require_columns, require_empty

FILE = "_metadata.file_name"


def read_csv_folder(spark: SparkSession, pattern: str, sep: str = ",") -> DataFrame:
    """All matching CSV files as strings, plus ``source_file``. Undecodable bytes do not stop the read."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-8").option("multiLine", False).csv(pattern)
    return df.select("*", F.col(FILE).alias("source_file"))


def read_fasta(spark: SparkSession, pattern: str) -> DataFrame:
    """FASTA, plain or gzip: ``header, raw_sequence, source_file, record_no``.

    The record delimiter makes each entry one row, so the file splits across tasks. Text ahead of
    the first ``>`` is dropped; a wrapped sequence is glued together.
    """
    blocks = spark.read.option("lineSep", "\n>").text(pattern).select(
        F.regexp_replace("value", "\r", "").alias("block"), F.col(FILE).alias("source_file"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_order"),
    )
    # Only the first block of a file keeps its own '>'; without one it is text before any entry.
    first_of_file = _first_block(blocks)
    marked = blocks.join(F.broadcast(first_of_file), ["_path", "_split", "_order"], "left")
    is_first = F.col("_first").isNotNull()
    starts = F.startswith(F.ltrim("block"), F.lit(">"))
    kept = marked.where(~is_first | starts).withColumn(
        "block", F.when(is_first, F.regexp_replace("block", r"^\s*>", "")).otherwise(F.col("block")))
    header = F.trim(F.substring_index("block", "\n", 1))
    body = F.regexp_replace(F.substring("block", 1, 2**31 - 1), r"^[^\n]*\n?", "")
    return kept.select(
        header.alias("header"), F.regexp_replace(body, r"\s+", "").alias("raw_sequence"), "source_file", "_path", "_split", "_order")


def _first_block(blocks: DataFrame) -> DataFrame:
    """One row per file: where its first record sits. Bounded by the number of files."""
    place = F.struct("_split", "_order")
    return blocks.groupBy("_path").agg(F.min(place).alias("p")).select(
        "_path", "p._split", "p._order", F.lit(1).alias("_first"))


def with_file_ordinal(entries: DataFrame, column: str = "record_id") -> DataFrame:
    """``file:n`` ids, 1-based in file order, for the readers of this module.

    Rows are numbered per (file, split) and earlier splits are added, so that one big file does
    not end up in one task.
    """
    sizes = entries.groupBy("_path", "_split").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_path", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_path", "_split").orderBy("_order")
    numbered = entries.withColumn("_row", F.row_number().over(inside)).join(offsets, ["_path", "_split"])
    position = (F.col("_before") + F.col("_row")).cast("string")
    return numbered.withColumn(column, F.concat_ws(":", "source_file", position)).drop("_path", "_split", "_order", "_row", "_before")


def read_labelled_fasta(spark: SparkSession, pattern: str) -> DataFrame:
    """Entries whose header ends in ``|0`` or ``|1``; ``label`` is null when it cannot be parsed."""
    return read_fasta(spark, pattern).withColumn("label", S.header_class(F.col("header")))


def list_files(spark: SparkSession, folder: str, suffixes: Sequence[str]) -> DataFrame:
    """Every file of a folder with a used / ignored mark by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"))
    used = F.lit(False)
    for suffix in suffixes:
        used = used | F.endswith(F.lower("file_name"), F.lit(suffix.lower()))
    return files.select("file_name", F.when(used, "used").otherwise("ignored").alias("status"))


def tag_by_spec(df: DataFrame, spec: Sequence[tuple[str, str, str, str]], key: str = "source_file") -> DataFrame:
    """Tag rows with (label, source_db, source_split) from a fixed per-file spec; other files are dropped."""
    table = df.sparkSession.createDataFrame(list(spec), [key, "label", "source_db", "source_split"])
    return df.join(F.broadcast(table), key)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        return spark.read.option("header", True).csv(path)
    raise ValueError(f"unsupported table suffix: {path}")


def read_json_list(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """A JSON array of strings, or one array field of a manifest, as (position, name); must not be empty."""
    text = spark.read.option("wholetext", True).text(path)
    array = "array<string>"
    parsed = F.from_json("value", array) if field is None else F.from_json(F.get_json_object("value", f"$.{field}"), array)
    rows = text.select(F.posexplode(parsed).alias("position", "name"))
    if not rows.take(1):
        raise ValueError(f"no entries in {path}")
    return rows


def read_predictions(spark: SparkSession, path: str, ids: Sequence[str], scores: Sequence[str],
                     sep: str = ",", comment: str | None = None) -> DataFrame:
    """Prediction files with alternative column names; a score that is no number becomes null."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    pick = lambda names: F.coalesce(*[F.col(f"`{n}`") for n in names if n in df.columns])
    if not set(ids) & set(df.columns) or not set(scores) & set(df.columns):
        raise ValueError(f"no id or score column in {path}: {df.columns}")
    return df.select(F.trim(pick(ids)).alias("fasta_id"), pick(scores).try_cast("double").alias("score"))


# Accepted names of the sequence column.
SEQUENCE_NAMES = ("sequence", "Sequence", "seq", "Seq")


def read_sequences_only(spark: SparkSession, path: str) -> DataFrame:
    """Only the sequences of a CSV: a known column, else the file is one column without header."""
    with_header = spark.read.option("header", True).csv(path)
    for name in SEQUENCE_NAMES:
        if name in with_header.columns:
            raw = with_header.select(F.col(name).alias("raw"))
            break
    else:
        raw = spark.read.csv(path).select(F.col("_c0").alias("raw"))
    return raw.select(S.normalise(F.col("raw")).alias("sequence")).where("sequence <> ''")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Cluster file (``>Cluster n`` lines, each followed by ``>id...`` member lines) as (cluster_id, member_id).

    Every line is a row, so a cluster may be longer than a split. A member belongs to the last header at or before
    it: a task passes over the lines of its splits in file order and holds one batch, and lines ahead of a split's first
    header take theirs from the summaries of earlier splits, one row per split. A member ahead of the first header of
    its file raises.
    """
    def carry(batches):
        place, last = None, None  # the split that is read and its last header
        for batch in batches:
            if not batch.num_rows:
                continue
            files, splits = batch.column("_file").dictionary_encode().indices.to_numpy(), batch.column("_split").to_numpy()
            names, own = batch.column("_file"), []
            cuts = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (names[a].as_py(), splits[a]) != place:
                    place, last = (names[a].as_py(), splits[a]), None
                filled = pc.fill_null_forward(batch.column("_header").slice(a, b - a))
                filled = pc.fill_null(filled, last) if last is not None else filled
                own.append(filled)
                last = filled[-1].as_py()
            rows = pa.RecordBatch.from_arrays([names, batch.column("_split"), pa.concat_arrays(own), batch.column("member_id")], names=["_file", "_split", "_own", "member_id"])
            yield rows.filter(pc.is_null(batch.column("_header")))

    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_order"),
        F.nullif(F.regexp_extract("value", r"^>Cluster\s+(\d+)\s*$", 1), F.lit("")).alias("_header"),
        F.nullif(F.regexp_extract("value", r">(.+?)\.\.\.", 1), F.lit("")).alias("member_id"))
    lines = lines.where("_header IS NOT NULL OR member_id IS NOT NULL")
    placed = lines.select("_file", "_split", "_header", "member_id").mapInArrow(carry, "_file string, _split long, _own string, member_id string")
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carried = lines.where("_header IS NOT NULL").groupBy("_file", "_split").agg(F.max_by("_header", "_order").alias("_last"))
    every = lines.select("_file", "_split").distinct().join(carried, ["_file", "_split"], "left")
    before = every.select("_file", "_split", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    orphan = F.raise_error("member line ahead of the first cluster").cast("string")
    return placed.join(F.broadcast(before), ["_file", "_split"]).select(  # one row per split
        F.coalesce("_own", "_carried", orphan).alias("cluster_id"), "member_id")


def load_split(raw: DataFrame, positive: str = "positive", negative: str = "negative") -> DataFrame:
    """Split table with checks: required columns, standard residues, label 0/1, derived columns.

    A bad row raises inside the job, so no extra pass is needed.
    """
    require_columns(raw, ["sequence", "label_id"])
    clean = raw.withColumn("sequence", S.normalise(F.col("sequence"))).withColumn("label_id", F.col("label_id").cast("int"))
    refuse = F.raise_error(F.concat(F.lit("non-standard sequence: "), F.col("sequence"))).cast("string")
    return clean.withColumn("sequence", F.when(S.is_standard(F.col("sequence")), F.col("sequence")).otherwise(refuse)).select(
        "*", F.length("sequence").cast("long").alias("length"), S.label_name(F.col("label_id"), positive, negative).alias("task_label"))


def known_sequences(df: DataFrame, column: str) -> DataFrame:
    """Reference sequences: trimmed, upper-case, alphabetic only."""
    upper = df.withColumn(column, F.upper(F.regexp_replace(column, r"^\s+|\s+$", "")))
    return upper.where(F.col(column).rlike("^[A-Z]+$"))


def latest_per_task(catalog: DataFrame, task: str, preference: Column) -> DataFrame:
    """Best catalogue row per task by a preference struct; combines map-side."""
    best = catalog.groupBy(task).agg(F.max_by(F.struct(*catalog.columns), preference).alias("_best"))
    return best.select("_best.*")


def load_candidates(df: DataFrame, id_column: str, sequence_column: str) -> DataFrame:
    """Candidate table: clean alphabet, length rule and unique ids, else an error."""
    require_columns(df, [id_column, sequence_column])
    seq = S.normalise(F.col(sequence_column))
    out = df.select(F.col(id_column).alias("candidate_id"), seq.alias("sequence")).withColumn("length", F.length("sequence").cast("long"))
    bad = out.groupBy("candidate_id").agg(
        F.count("*").alias("n"), F.count_if(~(S.is_standard(F.col("sequence")) & S.length_ok(F.col("sequence")))).alias("n_bad"))
    require_empty(bad.where("n > 1 OR n_bad > 0"), "duplicate or invalid candidates")
    return out
