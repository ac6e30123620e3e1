"""Cleaning, audit, deduplication, conflicts, set operations and sampling-free record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curation as C
from ..operators import ranking
from . import base as B
from .registry import query

c = F.col
WS = S.WHITESPACE
NORM = f"upper(replace(regexp_replace(raw, '{WS}', '', 'g'), 'ß', 'SS'))"


# --- sources and scalar rules -----------------------------------------------------------------

@query("S02_fragment_source", B.with_sql(B.RAW_FRAGS, """
SELECT doc_id, count(*) AS n_fragments, CAST(sum(length(raw)) AS BIGINT) AS n_chars_kept FROM raw_frags GROUP BY 1"""))
def _(t):
    return B.raw_fragments(t).groupBy("doc_id").agg(
        F.count("*").alias("n_fragments"), F.sum(F.length("raw")).alias("n_chars_kept"))


@query("S04_header_parts", """
SELECT page_id,
  CASE WHEN len(string_split(url, '/')) >= 3 THEN trim(string_split(url, '/')[2]) ELSE trim(url) END AS accession,
  CASE WHEN len(string_split(url, '/')) >= 3 THEN trim(string_split(url, '/')[3]) ELSE trim(url) END AS name
FROM pages""")
def _(t):
    accession, name = S.header_parts(c("url"), "/")
    return t.pages.select("page_id", accession.alias("accession"), name.alias("name"))


@query("S06_source_spec_tags", """
WITH spec AS (SELECT * FROM (VALUES ('en', 'positive', 'db1', 'train'), ('fr', 'negative', 'db1', 'train'),
  ('de', 'negative', 'db2', 'external')) v(lang, label, source_db, source_split))
SELECT d.source, s.label, s.source_db, s.source_split, count(*) AS n
FROM documents d JOIN spec s ON d.lang = s.lang GROUP BY ALL""")
def _(t):
    from ..sources.files import tag_by_spec

    spec = [("en", "positive", "db1", "train"), ("fr", "negative", "db1", "train"), ("de", "negative", "db2", "external")]
    tagged = tag_by_spec(t.documents, spec, "lang")
    return tagged.groupBy("source", "label", "source_db", "source_split").agg(F.count("*").alias("n"))


@query("S07_table_source", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    from ..sources.files import read_table

    return read_table(t.spark, f"{t.sf_dir}/documents.parquet").select("doc_id", "lang", "source", "n_chars")


@query("S12_split_loader", B.with_sql(B.FRAGS, """
SELECT f.record_id, f.seq AS sequence, l.toxic AS label_id, CAST(length(f.seq) AS BIGINT) AS length,
       CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'non_toxic' END AS task_label
FROM frags f JOIN labels l ON f.doc_id = l.doc_id"""))
def _(t):
    from ..sources.files import load_split

    raw = B.fragments(t).join(t.labels, "doc_id").select("record_id", c("seq").alias("sequence"), c("toxic").alias("label_id"))
    return load_split(raw, "toxic", "non_toxic")


@query("S13_known_reference", """
SELECT item_id, upper(trim(replace(w, 'ß', 'SS'), E' \\t\\n\\r')) AS word FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark)
WHERE regexp_full_match(upper(trim(replace(w, 'ß', 'SS'), E' \\t\\n\\r')), '[A-Z]+')""")
def _(t):
    from ..sources.files import known_sequences

    words = t.benchmark.select("item_id", F.explode(F.split("text", " ")).alias("word"))
    return known_sequences(words, "word")


@query("S14_latest_complete", """
SELECT o_custkey, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def _(t):
    from ..sources.files import latest_per_task

    order = F.struct((c("o_orderstatus") == "F"), "o_orderdate", "o_orderkey")
    return latest_per_task(t.orders, "o_custkey", order).select("o_custkey", "o_orderkey")


@query("S15_candidate_loader", B.with_sql(B.RECORDS, """
SELECT record_id AS candidate_id, sequence, CAST(length AS BIGINT) AS length FROM records"""))
def _(t):
    from ..sources.files import load_candidates

    return load_candidates(B.records(t), "record_id", "sequence")


@query("P01_normalise", B.with_sql(B.RAW_FRAGS, f"""
SELECT doc_id, frag_no, {NORM} AS clean FROM raw_frags"""))
def _(t):
    return B.raw_fragments(t).select("doc_id", "frag_no", S.normalise(c("raw")).alias("clean"))


WORDS_SQL = """words AS (SELECT doc_id, unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM documents)"""


@query("P02_strict_rejection", B.with_sql(B.RAW_FRAGS, f"""
, clean AS (SELECT {NORM} AS s FROM raw_frags),
reasons AS (SELECT CASE WHEN s = '' THEN 'empty_after_whitespace_cleanup'
  WHEN translate(s, '{S.RESIDUES}', '') <> '' THEN 'contains_non_standard_residue:' ||
    array_to_string(list_sort(list_distinct(string_split(translate(s, '{S.RESIDUES}', ''), ''))), '') END AS reason FROM clean)
SELECT reason, count(*) AS n FROM reasons GROUP BY 1""".lstrip()))
def _(t):
    clean = B.raw_fragments(t).select(S.normalise(c("raw")).alias("s"))
    return clean.select(S.strict_rejection(c("s")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("P03_lenient_clean", B.with_sql(B.FRAGS, "SELECT record_id, seq FROM frags"))
def _(t):
    return B.fragments(t).select("record_id", "seq")


@query("P04_length_rule", """
SELECT source, length(text) BETWEEN 10 AND 50 AS ok, count(*) AS n FROM documents GROUP BY ALL""")
def _(t):
    return t.documents.groupBy("source", S.length_ok(c("text")).alias("ok")).agg(F.count("*").alias("n"))


@query("P05_keyword_predicate", """
SELECT p_partkey, contains(upper(p_type), 'ECON') OR contains(upper(p_type), 'PROMO+') AS type_hit,
       contains(upper(p_name), 'RING') OR contains(upper(p_name), 'GRAM+') AS name_hit FROM part""")
def _(t):
    return t.part.select("p_partkey", S.has_keyword(c("p_type"), ("ECON", "PROMO+")).alias("type_hit"),
                         S.has_keyword(c("p_name"), ("RING", "GRAM+")).alias("name_hit"))


@query("P06_equality_filter", "SELECT o_orderkey FROM orders WHERE trim(o_orderstatus) = 'F'")
def _(t):
    return t.orders.where(F.trim("o_orderstatus") == "F").select("o_orderkey")


@query("P07_first_failure_audit", B.with_sql(B.RAW_FRAGS, f"""
, j AS (SELECT f.source, f.lang, {NORM} AS s, {B.seq_sql('raw')} AS q, l.quality FROM raw_frags f LEFT JOIN labels l ON f.doc_id = l.doc_id)
SELECT source, CASE WHEN lang = 'de' THEN 'skip_wrong_type' WHEN quality IS NULL THEN 'skip_missing_label'
  WHEN s = '' THEN 'skip_empty_after_clean' WHEN q = '' THEN 'skip_non_standard_sequence'
  WHEN NOT length(q) BETWEEN 10 AND 50 THEN 'skip_length_filter' ELSE 'kept_rows' END AS outcome, count(*) AS "rows"
FROM j GROUP BY ALL""".lstrip()))
def _(t):
    joined = B.raw_fragments(t).join(t.labels, "doc_id", "left").withColumn("seq", S.lenient_clean(c("raw")))
    rules = [
        ("skip_wrong_type", c("lang") == "de"),
        ("skip_missing_label", c("quality").isNull()),
        ("skip_empty_after_clean", S.normalise(c("raw")) == ""),
        ("skip_non_standard_sequence", c("seq") == ""),
        ("skip_length_filter", ~S.length_ok(c("seq"))),
    ]
    return C.audit_report(C.charge_first_failure(joined, rules), ["source"])


@query("P08_canonical_record", B.with_sql(B.LABELLED, """
SELECT sequence, CAST(length AS BIGINT) AS length, label, source_db, source_split, source_file, record_id, record_name, raw_sequence, raw_label
FROM labelled"""))
def _(t):
    return B.labelled(t).select("sequence", "length", "label", "source_db", "source_split", "source_file",
                                "record_id", "record_name", "raw_sequence", "raw_label")


@query("P09_label_maps", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS label, toxic AS label_id,
       CASE WHEN toxic = 1 THEN 'toxic' ELSE 'non_toxic' END AS task_label FROM labels""")
def _(t):
    named = t.labels.select("doc_id", S.label_name(c("toxic")).alias("label"))
    ids = named.withColumn("label_id", S.label_id(c("label")))
    return ids.withColumn("task_label", S.label_name(c("label_id"), "toxic", "non_toxic"))


@query("P10_provided_split", """
SELECT doc_id, CASE WHEN source = 'src0' THEN 'provided_train' ELSE 'provided_' || lower(source) END AS split FROM documents""")
def _(t):
    file_name = F.when(c("source") == "src0", "train_data.txt").otherwise(F.concat("source", F.lit(".txt")))
    return t.documents.select("doc_id", S.provided_split(file_name).alias("split"))


@query("P11_token_cleanup", B.with_sql(B.RAW_FRAGS, f"""
, s AS (SELECT doc_id, frag_no, regexp_replace({NORM.replace("regexp_replace(raw", "regexp_replace(raw || '<eos>'")}, '<CLS>|<EOS>|<PAD>|-', '', 'g') AS clean FROM raw_frags)
SELECT doc_id, frag_no, clean, clean <> '' AND translate(clean, '{S.RESIDUES}', '') = '' AND length(clean) BETWEEN 10 AND 50 AS valid FROM s""".lstrip()))
def _(t):
    tokens = B.raw_fragments(t).withColumn("clean", S.strip_tokens(F.concat("raw", F.lit("<eos>"))))
    return tokens.select("doc_id", "frag_no", "clean", (S.is_standard(c("clean")) & S.length_ok(c("clean"))).alias("valid"))


@query("P12_shortcut_flags", B.with_sql(B.FRAGS, f"""
SELECT record_id, starts_with(seq, 'M') AS starts_m, contains(seq, 'C') AS contains_c,
       CAST({B.count_sql('seq', 'C')} AS BIGINT) AS c_count, {B.r6_sql(B.count_sql('seq', 'C') + ' / greatest(length(seq), 1)')} AS c_frequency
FROM frags"""))
def _(t):
    s = c("seq")
    return B.fragments(t).select(
        "record_id", F.startswith(s, F.lit("M")).alias("starts_m"), F.contains(s, F.lit("C")).alias("contains_c"),
        S.count_chars(s, "C").cast("long").alias("c_count"), S.r6(S.char_frequency(s, "C")).alias("c_frequency"))


@query("P14_integrity", """
SELECT conv_id AS key, count(*) AS n FROM conversations GROUP BY 1 HAVING min(text) <> max(text)""")
def _(t):
    return C.ambiguous_keys(t.conversations, "conv_id", "text").withColumnRenamed("conv_id", "key")


# --- duplicates and conflicts -------------------------------------------------------------------

JOIN = "array_to_string(list_sort(list(DISTINCT {0})), ';')"


@query("A01_conflict_report", B.with_sql(B.LABELLED, f"""
SELECT sequence, CAST(length(sequence) AS BIGINT) AS length, {JOIN.format('label')} AS labels,
       {JOIN.format("source_db || ':' || source_split")} AS sources, {JOIN.format('source_file')} AS source_files, count(*) AS n_records
FROM labelled GROUP BY sequence HAVING count(DISTINCT label) > 1"""))
def _(t):
    report = C.conflict_report(B.labelled(t))
    join = lambda k: F.array_join(k, ";").alias(k)
    return report.select("sequence", "length", join("labels"), join("sources"), join("source_files"), "n_records")


@query("A01_conflict_members", B.with_sql(B.LABELLED, """
SELECT sequence, label, record_id FROM labelled
WHERE sequence IN (SELECT sequence FROM labelled GROUP BY 1 HAVING count(DISTINCT label) > 1)"""))
def _(t):
    df = B.labelled(t)
    return df.join(C.conflict_report(df).select("sequence"), "sequence", "left_semi").select("sequence", "label", "record_id")


@query("A02_dedup_records", B.with_sql(B.LABELLED, f"""
SELECT sequence, label, CAST(length(sequence) AS BIGINT) AS length, count(*) AS support_count, {JOIN.format('source_db')} AS source_dbs,
       {JOIN.format('source_split')} AS source_splits, {JOIN.format('source_file')} AS source_files,
       {JOIN.format('raw_label').replace("';'", "' || '")} AS raw_labels,
       coalesce(arg_min(CASE WHEN record_name <> '' THEN record_name END,
                        CASE WHEN record_name <> '' THEN doc_id * 1000000 + frag_no END), '') AS example_name
FROM labelled GROUP BY sequence, label"""))
def _(t):
    df = C.deduplicate(B.labelled(t))
    join = lambda k, sep=";": F.array_join(k, sep).alias(k)
    return df.select("sequence", "label", "length", "support_count", join("source_dbs"), join("source_splits"),
                     join("source_files"), join("raw_labels", " || "), "example_name")


@query("A02_record_lineage", B.with_sql(B.LABELLED, "SELECT sequence, label, record_id, doc_id, frag_no FROM labelled"))
def _(t):
    return C.lineage(B.labelled(t))


@query("A03_dataset_summary", B.with_sql(B.UNIQ, """
SELECT count(*) AS unique_sequences, count(*) FILTER (label = 'positive') AS positive_unique,
       count(*) FILTER (label = 'negative') AS negative_unique, CAST(sum(support_count) AS BIGINT) AS support_sum,
       CAST(sum(support_count) - count(*) AS BIGINT) AS duplicate_records_collapsed,
       round(count(*) FILTER (label = 'negative') / count(*) FILTER (label = 'positive') * 1e6) / 1e6 AS negative_to_positive_ratio
FROM uniq"""))
def _(t):
    return C.dataset_summary(B.unique_rows(t))


@query("J01_conflict_anti_join", B.with_sql(B.LABELLED, """
SELECT record_id, sequence, label FROM labelled
WHERE sequence NOT IN (SELECT sequence FROM labelled GROUP BY 1 HAVING count(DISTINCT label) > 1)"""))
def _(t):
    return C.drop_conflicting_records(B.labelled(t)).select("record_id", "sequence", "label")


@query("A10_source_signature", B.with_sql(B.UNIQ, """
SELECT array_to_string(source_dbs, '+') AS signature,
  CASE WHEN list_contains(source_dbs, 'src1') AND list_contains(source_dbs, 'src2') THEN 'src1_plus_src2'
       WHEN list_contains(source_dbs, 'src1') THEN 'src1_only' WHEN list_contains(source_dbs, 'src2') THEN 'src2_only'
       ELSE 'other_negative' END AS source_group, label, count(*) AS n
FROM uniq GROUP BY ALL"""))
def _(t):
    return B.unique_rows(t).groupBy(
        S.source_signature(c("source_dbs")).alias("signature"),
        S.source_group(c("source_dbs"), "src1", "src2").alias("source_group"), "label").agg(F.count("*").alias("n"))


@query("A30_value_counts", """
SELECT coalesce(CAST(l.quality AS VARCHAR), 'missing') AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def _(t):
    # quality is null for documents without a label: the null group is kept
    counts = t.documents.join(t.labels, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce(c("quality").cast("string"), F.lit("missing")).alias("quality"), "n")


# --- joins on records -----------------------------------------------------------------------------

@query("J03_modality_join", B.with_sql(B.FRAGS, """
SELECT f.doc_id, f.n_frag, e.label AS emb_label, CAST(len(e.embedding) AS BIGINT) AS dim
FROM (SELECT doc_id, count(*) AS n_frag FROM frags GROUP BY 1) f JOIN embeddings e ON e.vec_id = f.doc_id"""))
def _(t):
    emb = t.embeddings.select(c("vec_id").alias("doc_id"), c("label").alias("emb_label"), F.size("embedding").cast("long").alias("dim"))
    ccd = B.fragments(t).groupBy("doc_id").agg(F.count("*").alias("n_frag")).join(emb, "doc_id", "left_semi")
    return C.left_join_complete(ccd, emb, "doc_id", "dim")


@query("J04_split_alignment", """
WITH feats AS (SELECT text, length(text) AS feature FROM (SELECT DISTINCT text FROM documents))
SELECT d.doc_id, d.lang AS split, CAST(f.feature AS BIGINT) AS feature FROM documents d JOIN feats f ON d.text = f.text""")
def _(t):
    from ..operators.features import compute_once_and_fan_out

    members = t.documents.select("doc_id", c("lang").alias("split"), "text")
    return compute_once_and_fan_out(
        members, "text", lambda distinct: distinct.withColumn("feature", F.length("text").cast("long"))).drop("text")


@query("J05_score_attachment", """
SELECT p.p_partkey, p.p_name, p.p_size, s.avg_qty, s.n_lines FROM part p LEFT JOIN (
  SELECT l_partkey, round(avg(l_quantity) * 1e6) / 1e6 AS avg_qty, count(*) AS n_lines FROM lineitem GROUP BY 1) s ON s.l_partkey = p.p_partkey
WHERE s.n_lines IS NOT NULL""")
def _(t):
    scores = t.lineitem.groupBy(c("l_partkey").alias("p_partkey")).agg(
        S.r6(F.avg("l_quantity")).alias("avg_qty"), F.count("*").alias("n_lines"),
        F.lit("ignored").alias("p_name"), F.lit("ignored").alias("sequence"))
    cands = t.part.select("p_partkey", "p_name", "p_size")
    return C.new_columns_join(cands, scores, "p_partkey").where("n_lines IS NOT NULL")


@query("J06_candidate_feature_join", """
SELECT d.doc_id, d.source AS label, e.label AS label_esm, CAST(len(e.embedding) AS BIGINT) AS dim
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(t):
    left = t.documents.select("doc_id", c("source").alias("label"))
    right = t.embeddings.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))
    return C.suffixed_join(left, right, "doc_id", "_esm", right_key="vec_id")


@query("J07_prediction_join", """
SELECT o.o_orderkey, o.o_orderstatus, s.score FROM orders o JOIN (
  SELECT l_orderkey, round(avg(l_discount) * 1e6) / 1e6 AS score FROM lineitem GROUP BY 1) s ON s.l_orderkey = o.o_orderkey""")
def _(t):
    scores = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(S.r6(F.avg("l_discount")).alias("score"))
    truth = t.orders.select("o_orderkey", "o_orderstatus").join(scores, "o_orderkey", "left_semi")
    return C.left_join_complete(truth, scores, "o_orderkey", "score")


@query("J09_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("J12_id_alignment", """
SELECT coalesce(o_orderkey, l_orderkey) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'right_only' ELSE 'left_only' END AS side
FROM (SELECT DISTINCT o_orderkey FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey
WHERE o_orderkey IS NULL OR l_orderkey IS NULL""")
def _(t):
    lines = t.lineitem.select(c("l_orderkey").alias("o_orderkey")).distinct()
    return C.misaligned_ids(t.orders.select("o_orderkey").distinct(), lines, "o_orderkey")


# --- set operations ---------------------------------------------------------------------------------

@query("U01_union_all", B.with_sql(B.FRAGS, """
SELECT source, count(*) AS n FROM (
  SELECT source FROM frags WHERE lang = 'en' UNION ALL SELECT source FROM frags WHERE lang <> 'en'
  UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY 1"""))
def _(t):
    f = B.fragments(t).select("source", "lang")
    known = t.benchmark.select(F.lit("benchmark").alias("source"), F.lit("-").alias("lang"))
    return f.where("lang = 'en'").unionByName(f.where("lang <> 'en'")).unionByName(known).groupBy("source").agg(F.count("*").alias("n"))


@query("U02_union_distinct", """
SELECT p_partkey AS k FROM part WHERE p_size > 20 UNION SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def _(t):
    a = t.part.where("p_size > 20").select(c("p_partkey").alias("k"))
    return a.union(t.lineitem.where("l_quantity > 45").select("l_partkey")).distinct()


@query("U03_intersect", """
SELECT p_partkey AS k FROM part WHERE p_size > 20 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def _(t):
    a = t.part.where("p_size > 20").select(c("p_partkey").alias("k"))
    return a.intersect(t.lineitem.where("l_quantity > 45").select("l_partkey"))


@query("U04_except", """
SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45""")
def _(t):
    return t.part.select(c("p_partkey").alias("k")).subtract(t.lineitem.where("l_quantity > 45").select("l_partkey"))


@query("U05_keep_first", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1""")
def _(t):
    return C.keep_first(t.conversations, ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


@query("W01_sequential_ids", B.with_sql(B.UNIQ, """
SELECT 'seq_' || lpad(CAST(row_number() OVER (ORDER BY CASE WHEN label = 'positive' THEN 0 ELSE 1 END, sequence) AS VARCHAR), 6, '0') AS fasta_id,
       sequence, label FROM uniq"""))
def _(t):
    df = B.unique_rows(t).select("sequence", "label")
    order = [F.when(c("label") == "positive", 0).otherwise(1).asc(), c("sequence").asc()]
    return ranking.assign_ids(df, order, "seq", "fasta_id")


@query("U07_pool_assembly", B.with_sql(B.FRAGS, """
, pool AS (SELECT seq AS sequence, min(doc_id * 1000000 + frag_no) AS pos FROM frags
  WHERE length(seq) BETWEEN 10 AND 50 AND seq NOT IN (SELECT upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) FROM benchmark) GROUP BY 1),
numbered AS (SELECT sequence, row_number() OVER (ORDER BY pos) AS i FROM pool)
SELECT 'pool_' || lpad(CAST(i AS VARCHAR), 5, '0') AS candidate_id, sequence, 'pool' AS candidate_source FROM numbered WHERE i <= 500
UNION ALL SELECT 'LEAD', 'KWKLFKKIGIGKFLHSAK', 'lead'""".lstrip()))
def _(t):
    from ..operators.screening import assemble_pool

    valid = B.records(t).select("sequence", (c("doc_id") * 1000000 + c("frag_no")).alias("pos"))
    seen = t.benchmark.select(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))
    return assemble_pool(valid, seen, "pool", 500, lead=("LEAD", "KWKLFKKIGIGKFLHSAK", "lead"))
