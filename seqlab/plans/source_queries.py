"""File sources and sinks: every format is written from a table into the shared folder and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder
from ..sources import files, sinks
from . import base as B
from .registry import query

c = F.col


@query("S01_csv_folder", """
SELECT event_id, user_id, event_type, coalesce(props, '') AS props, TRUE AS has_file FROM events""")
def _(t):
    path = shared_folder(t.spark, "events")
    sinks.write_csv(t.events.select("event_id", "user_id", "event_type", "props"), path)
    back = files.read_csv_folder(t.spark, f"{path}/*.csv")
    return back.select(
        c("event_id").cast("long").alias("event_id"), c("user_id").cast("long").alias("user_id"), "event_type",
        F.coalesce("props", F.lit("")).alias("props"), F.endswith("source_file", F.lit(".csv")).alias("has_file"))


@query("S02_fasta_gzip", B.with_sql(B.FRAGS, "SELECT record_id AS header, seq AS raw_sequence FROM frags"))
def _(t):
    path = shared_folder(t.spark, "fasta-gzip")
    sinks.write_fasta(B.fragments(t), path, c("record_id"), "seq", strict=True, compression="gzip")
    return files.read_fasta(t.spark, f"{path}/*.gz").select("header", "raw_sequence")


@query("S03_labelled_fasta", B.with_sql(B.FRAGS, """
SELECT f.record_id || CASE WHEN l.toxic IS NULL THEN '' ELSE '|' || l.toxic END AS header, f.seq AS raw_sequence,
       coalesce(CAST(l.toxic AS VARCHAR), '') AS label
FROM frags f LEFT JOIN labels l ON f.doc_id = l.doc_id"""))
def _(t):
    path = shared_folder(t.spark, "fasta-labelled")
    marked = B.fragments(t).join(t.labels, "doc_id", "left")
    sinks.write_fasta(marked, path, F.concat_ws("|", "record_id", c("toxic").cast("string")), "seq")
    back = files.read_labelled_fasta(t.spark, path)
    return back.select("header", "raw_sequence", F.coalesce("label", F.lit("")).alias("label"))


@query("S05_directory_report", B.with_sql(B.FRAGS, """
SELECT '.csv' AS suffix, 'used' AS status, count(*) AS n_records FROM frags UNION ALL SELECT '.txt', 'ignored', count(*) FROM frags"""))
def _(t):
    """Records of a folder by suffix, with the allow-list's verdict on the files that hold them."""
    path = shared_folder(t.spark, "directory")
    frags = B.fragments(t).select("record_id", "seq")
    sinks.write_csv(frags, f"{path}/tables")
    sinks.write_fasta(frags, f"{path}/entries", c("record_id"), "seq")
    suffix = lambda name: F.concat(F.lit("."), F.substring_index(name, ".", -1)).alias("suffix")
    status = files.list_files(t.spark, path, [".csv"]).select(suffix(c("file_name")), "status").distinct()
    tables = files.read_csv_folder(t.spark, f"{path}/tables").select(suffix(c("source_file")))
    entries = files.read_fasta(t.spark, f"{path}/entries").select(suffix(c("source_file")))
    held = tables.unionByName(entries).groupBy("suffix").agg(F.count("*").alias("n_records"))
    return held.join(status, "suffix").select("suffix", "status", "n_records")


def _manifest(t) -> str:
    path = shared_folder(t.spark, "manifest")
    totals = F.struct(F.count("*").alias("rows"), F.sum("n_chars").alias("chars")).alias("totals")
    sinks.write_manifest(t.documents.agg(F.array_sort(F.collect_set("source")).alias("groups"), totals), path)
    return path


@query("S08_json_list", """
SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INT) AS position, source AS name
FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)""")
def _(t):
    return files.read_json_list(t.spark, _manifest(t), "groups")


@query("K05_manifest", "SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents")
def _(t):
    return t.spark.read.json(_manifest(t)).select(c("totals.rows").alias("n_rows"), c("totals.chars").alias("n_chars"))


@query("S09_prediction_files", """
SELECT CAST(doc_id AS VARCHAR) AS fasta_id, CASE WHEN toxic = 1 THEN -1.0 ELSE quality * 0.75 + 0.125 END AS score FROM labels""")
def _(t):
    """Tab separated, another id name, and a word where a score is missing (-1 in the result)."""
    path = shared_folder(t.spark, "predictions")
    score = F.when(c("toxic") == 1, "failed").otherwise((c("quality") * 0.75 + 0.125).cast("string"))
    sinks.write_csv(t.labels.select(c("doc_id").alias("ID"), score.alias("prob")), path, sep="\t")
    back = files.read_predictions(t.spark, path, ["fasta_id", "ID"], ["score", "prob"], "\t", "#")
    return back.select("fasta_id", F.coalesce("score", F.lit(-1.0)).alias("score"))


@query("S10_sequence_only", B.with_sql(B.RECORDS, "SELECT sequence FROM records"))
def _(t):
    path = shared_folder(t.spark, "sequences")
    sinks.write_csv(B.records(t).select("record_id", c("sequence").alias("Seq")), path)
    return files.read_sequences_only(t.spark, path)


@query("S11_cluster_file", """
SELECT CAST(l_suppkey AS VARCHAR) AS cluster_id, l_orderkey || '_' || l_linenumber AS member_id FROM lineitem""")
def _(t):
    path = shared_folder(t.spark, "clusters")
    member = F.concat_ws("_", c("l_orderkey").cast("string"), c("l_linenumber").cast("string"))
    lines = t.lineitem.select("l_suppkey", member.alias("member"), c("l_quantity").cast("int").alias("length"))
    sinks.write_clusters(lines, path, "l_suppkey", "member", "length")
    return files.read_clusters(t.spark, path)


@query("K01_csv_sink", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def _(t):
    path = f"{shared_folder(t.spark, 'part')}.csv"
    sinks.write_csv(t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path)
    return files.read_table(t.spark, path).select(
        c("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", c("p_size").cast("int").alias("p_size"),
        c("p_retailprice").cast("double").alias("p_retailprice"))


@query("K02_fasta_sink", B.with_sql(B.RECORDS, """
SELECT record_id || '|label=' || source_split || '|sources=' || source_db || '|splits=' || source_file || '|length=' || length AS header,
       sequence AS raw_sequence FROM records"""))
def _(t):
    path = shared_folder(t.spark, "fasta")
    header = sinks.composed_header("source_split", "source_db", "source_file", "record_id")
    sinks.write_fasta(B.records(t), path, header, strict=True)
    return files.read_fasta(t.spark, path).select("header", "raw_sequence")


@query("K03_split_bundle", B.with_sql(B.RECORDS, """
SELECT 'csv' AS form, source_split AS split, record_id, sequence FROM records
UNION ALL SELECT 'fasta', '', record_id, sequence FROM records"""))
def _(t):
    path = shared_folder(t.spark, "bundle")
    rows = B.records(t).select(c("record_id"), "sequence", c("source_split").alias("split"))
    sinks.write_split_bundle(rows, path, key="record_id")
    tables = t.spark.read.option("header", True).csv(f"{path}/csv").select(F.lit("csv").alias("form"), "split", "record_id", "sequence")
    entries = files.read_fasta(t.spark, f"{path}/fasta").select(
        F.lit("fasta").alias("form"), F.lit("").alias("split"), c("header").alias("record_id"), c("raw_sequence").alias("sequence"))
    return tables.unionByName(entries)


@query("K04_table_sink", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def _(t):
    path = f"{shared_folder(t.spark, 'orders')}.parquet"
    sinks.write_table(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return files.read_table(t.spark, path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("K06_feature_bundle", """
SELECT task, CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, d.doc_id, label_id, d.n_chars, CAST(length(d.text) AS BIGINT) AS n_points
FROM documents d JOIN (SELECT doc_id, 'quality' AS task, quality AS label_id FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l
  ON d.doc_id = l.doc_id""")
def _(t):
    """Both tasks and both splits in one table, every labelled document once per task."""
    path = shared_folder(t.spark, "features")
    features = t.documents.select("doc_id", "n_chars", F.length("text").cast("long").alias("n_points"))
    split = F.when(c("doc_id") % 5 == 0, "test").otherwise("train")
    parts: list[DataFrame] = []
    for task in ("quality", "toxic"):
        rows = features.join(t.labels.select("doc_id", c(task).alias("label_id")), "doc_id").withColumn("task", F.lit(task)).withColumn("split", split)
        parts += [rows.where(c("split") == name) for name in ("train", "test")]
    sinks.write_feature_bundle(parts, ["doc_id", "label_id"], ["n_chars", "n_points"], path)
    return t.spark.read.parquet(path).select("task", "split", "doc_id", "label_id", "n_chars", "n_points")


@query("W08_file_ordinal", B.with_sql(B.FRAGS, """
SELECT CAST(count(*) AS BIGINT) AS n_records, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS out_of_order FROM frags"""))
def _(t):
    """Entries are written sorted by id. Their ordinals must count 1 to n in every file and follow that order."""
    path = shared_folder(t.spark, "ordinals")
    key = F.concat_ws(":", F.lpad(c("doc_id").cast("string"), 20, "0"), F.lpad(c("frag_no").cast("string"), 20, "0"))
    entries = B.fragments(t).select(key.alias("key"), "seq").repartitionByRange("key").sortWithinPartitions("key")
    sinks.write_fasta(entries, path, c("key"), "seq")
    ids = files.with_file_ordinal(files.read_fasta(t.spark, path))
    placed = ids.select("source_file", "header", F.substring_index("record_id", ":", -1).cast("long").alias("ordinal"))
    # written order and ordinal agree when each ordinal's header is above the one before; buckets keep the sort small
    width = 1 << 16
    inside = Window.partitionBy("source_file", F.floor(c("ordinal") / width)).orderBy("ordinal")
    ordered = placed.withColumn("_back", (F.lag("header").over(inside) >= c("header")).cast("long"))
    per_file = ordered.groupBy("source_file").agg(
        F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"),
        F.coalesce(F.sum("_back"), F.lit(0)).alias("back"))
    gap = ((c("n") != c("d")) | (c("lo") != 1) | (c("hi") != c("n"))).cast("long")
    return per_file.agg(F.sum("n").alias("n_records"), F.sum(gap).alias("gaps"), F.sum("back").alias("out_of_order"))
