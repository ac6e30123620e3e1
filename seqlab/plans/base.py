"""Record views over the test tables, each in Spark and as a SQL common table expression.

A text is cut at sentence ends into fragments, so whole texts are used. A fragment plays the
part of one raw sequence record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import lenient_clean, length_ok
from ..session import spread

SENTENCE_END = r"[.!?\n]+"
KEEP = "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]"


# --- SQL side -------------------------------------------------------------------------------

def seq_sql(expr: str) -> str:
    return f"upper(regexp_replace(coalesce({expr}, ''), '{KEEP}', '', 'g'))"


def r6_sql(expr: str) -> str:
    return f"(round(({expr}) * 1e6) / 1e6 + 0.0)"


def r9_sql(expr: str) -> str:
    return f"(round(({expr}) * 1e9) / 1e9 + 0.0)"


def u_sql(seed: int, stage: str, *keys: str) -> str:
    args = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (
        f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{stage}', {args})), 1, 13) AS BIGINT)"
        " / 4503599627370496.0::DOUBLE)"
    )


def count_sql(seq: str, chars: str) -> str:
    return f"(length({seq}) - length(translate({seq}, '{chars}', '')))"


RAW_FRAGS = f"""raw_frags AS MATERIALIZED (
  SELECT doc_id, lang, source, unnest(range(1, len(parts) + 1)) AS frag_no, unnest(parts) AS raw
  FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '[.!?\\n]+') AS parts FROM documents))"""

FRAGS = f"""{RAW_FRAGS},
frags AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, lang, source, frag_no, raw, doc_id || ':' || frag_no AS record_id,
                        {seq_sql('raw')} AS seq FROM raw_frags) WHERE seq <> '')"""

RECORDS = f"""{FRAGS},
records AS MATERIALIZED (
  SELECT seq AS sequence, length(seq) AS length, source AS source_db, lang AS source_split,
         source || '_' || lang AS source_file, record_id,
         CASE WHEN frag_no = 1 THEN '' ELSE 'name ' || frag_no END AS record_name, raw AS raw_sequence,
         doc_id, frag_no
  FROM frags WHERE length(seq) BETWEEN 10 AND 50)"""

# Every fragment as a record, whatever its length: for descriptors the length rule is no part of.
EVERY = f"""{FRAGS},
records AS MATERIALIZED (SELECT seq AS sequence, length(seq) AS length, source AS source_db, record_id FROM frags)"""

_LABELLED = """
  SELECT r.*, CASE WHEN l.{col} = 1 THEN 'positive' ELSE 'negative' END AS label,
         '{col}=' || l.{col} AS raw_label
  FROM records r JOIN labels l ON r.doc_id = l.doc_id"""

# Records of the first task (quality) and of the second task (toxic).
LABELLED = f"{RECORDS},\nlabelled AS MATERIALIZED ({_LABELLED.format(col='quality')})"
LABELLED_B = f"{RECORDS},\nlabelled AS MATERIALIZED ({_LABELLED.format(col='toxic')})"

_CLEANED = """,
conflicts AS (SELECT sequence FROM labelled GROUP BY 1 HAVING count(DISTINCT label) > 1),
uniq AS MATERIALIZED (
  SELECT sequence, label, length(sequence) AS length, count(*) AS support_count,
         list_sort(list(DISTINCT source_db)) AS source_dbs,
         md5(sequence || '|' || label) AS uid
  FROM labelled WHERE sequence NOT IN (SELECT sequence FROM conflicts) GROUP BY sequence, label)"""

# Unique, conflict-free rows of each task.
UNIQ = LABELLED + _CLEANED
UNIQ_B = LABELLED_B + _CLEANED

CAND = """cand AS MATERIALIZED (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS cand_id,
         l_extendedprice / 105000.0::DOUBLE AS score_a, l_quantity / 50.0::DOUBLE AS score_m,
         l_discount * 10.0::DOUBLE AS score_b, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         l_linestatus = 'O' AS qc_pass, l_tax >= 0.06 AS low_complexity, l_linenumber >= 6 AS homopolymer,
         l_suppkey % 7 = 0 AS gf_rich, l_returnflag AS pool, l_linenumber AS len,
         l_orderkey, l_partkey
  FROM lineitem)"""

# Metric rows: task, model, seed and split come from the event columns; two metric values per event.
METRIC_ROWS = """metric_rows AS MATERIALIZED (
  SELECT event_type AS task, 'm' || (event_id % 4) AS model, CAST(user_id % 5 AS BIGINT) AS seed,
         CASE WHEN hour(ts) < 12 THEN 'test' ELSE 'hard' END AS split,
         value / 500.0::DOUBLE AS roc, value / (value + 50.0::DOUBLE) AS pr, user_id, event_id
  FROM events)"""

# One value per (task, model, seed, split), the shape of a results file.
RESULTS = f"""{METRIC_ROWS},
results AS MATERIALIZED (
  SELECT task, model, seed, split, avg(roc) AS roc, avg(pr) AS pr FROM metric_rows GROUP BY ALL)"""

SUMMARY = f"""{RESULTS},
summary AS MATERIALIZED (
  SELECT task, model, split, avg(roc) AS mean_roc, stddev_pop(roc) AS std_roc,
         avg(pr) AS mean_pr, stddev_pop(pr) AS std_pr, count(DISTINCT seed) AS n_seeds
  FROM results GROUP BY task, model, split)"""


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# --- Spark side -----------------------------------------------------------------------------

def raw_fragments(t) -> DataFrame:
    return spread(t.documents.select("doc_id", "lang", "source", "text")).select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", SENTENCE_END)).alias("pos", "raw")
    ).select("doc_id", "lang", "source", (F.col("pos") + 1).cast("long").alias("frag_no"), "raw")


def record_key() -> Column:
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.col("frag_no").cast("string"))


def fragments(t) -> DataFrame:
    df = raw_fragments(t).withColumn("record_id", record_key())
    return df.withColumn("seq", lenient_clean(F.col("raw"))).where("seq <> ''")


def every_record(t) -> DataFrame:
    """All fragments in the columns of records, without the length rule."""
    return fragments(t).select(F.col("seq").alias("sequence"), F.length("seq").cast("long").alias("length"), F.col("source").alias("source_db"), "record_id")


def records(t) -> DataFrame:
    """Canonical records: fragments that pass the length rule."""
    df = fragments(t).where(length_ok(F.col("seq")))
    return df.select(
        F.col("seq").alias("sequence"),
        F.length("seq").cast("long").alias("length"),
        F.col("source").alias("source_db"),
        F.col("lang").alias("source_split"),
        F.concat_ws("_", "source", "lang").alias("source_file"),
        "record_id",
        F.when(F.col("frag_no") == 1, "").otherwise(F.concat(F.lit("name "), F.col("frag_no").cast("string"))).alias("record_name"),
        F.col("raw").alias("raw_sequence"),
        "doc_id", "frag_no",
    )


def labelled(t, column: str = "quality") -> DataFrame:
    marks = t.labels.select(
        "doc_id",
        F.when(F.col(column) == 1, "positive").otherwise("negative").alias("label"),
        F.concat(F.lit(f"{column}="), F.col(column).cast("string")).alias("raw_label"),
    )
    return records(t).join(marks, "doc_id")


def unique_rows(t, column: str = "quality") -> DataFrame:
    from ..operators.curation import conflict_free, deduplicate

    df = conflict_free(deduplicate(labelled(t, column)))
    return df.withColumn("uid", F.md5(F.concat_ws("|", "sequence", "label")))


def candidates(t) -> DataFrame:
    c = F.col
    lines = spread(t.lineitem.drop("l_shipdate"))
    return lines.select(
        F.concat_ws("-", *[c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                    F.round(c("l_extendedprice") * 100).cast("long").cast("string")).alias("cand_id"),
        (c("l_extendedprice") / 105000.0).alias("score_a"),
        (c("l_quantity") / 50.0).alias("score_m"),
        (c("l_discount") * 10.0).alias("score_b"),
        F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (c("l_linestatus") == "O").alias("qc_pass"),
        (c("l_tax") >= 0.06).alias("low_complexity"),
        (c("l_linenumber") >= 6).alias("homopolymer"),
        (c("l_suppkey") % 7 == 0).alias("gf_rich"),
        c("l_returnflag").alias("pool"),
        c("l_linenumber").alias("len"),
        "l_orderkey", "l_partkey",
    )


def predictions(t) -> DataFrame:
    """Long prediction table: two models scored on the same rows."""
    c = candidates(t)
    models = F.array(
        F.struct(F.lit("a").alias("model"), F.col("score_a").alias("prob")),
        F.struct(F.lit("m").alias("model"), F.col("score_m").alias("prob")),
    )
    return c.select("cand_id", "label", F.explode(models).alias("p")).select("cand_id", "label", "p.model", "p.prob")


PRED = f"""{CAND},
pred AS MATERIALIZED (
  SELECT cand_id, label, 'a' AS model, score_a AS prob FROM cand
  UNION ALL SELECT cand_id, label, 'm', score_m FROM cand)"""


def metric_rows(t) -> DataFrame:
    c = F.col
    return t.events.select(
        c("event_type").alias("task"),
        F.concat(F.lit("m"), (c("event_id") % 4).cast("string")).alias("model"),
        (c("user_id") % 5).alias("seed"),
        F.when(F.hour("ts") < 12, "test").otherwise("hard").alias("split"),
        (c("value") / 500.0).alias("roc"),
        (c("value") / (c("value") + 50.0)).alias("pr"),
        "user_id", "event_id",
    )


def results(t) -> DataFrame:
    return metric_rows(t).groupBy("task", "model", "seed", "split").agg(F.avg("roc").alias("roc"), F.avg("pr").alias("pr"))


def summary(t) -> DataFrame:
    from ..operators.comparison import seed_summary

    return seed_summary(results(t), ["task", "model", "split"], ["roc", "pr"])
