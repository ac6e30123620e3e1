"""Similarity joins, clustering and novelty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import similarity as SIM
from . import base as B
from .registry import query

c = F.col
R = B.r6_sql
KNOWN = B.RECORDS + f""", known AS MATERIALIZED (SELECT seq AS known, min(k) AS idx FROM (SELECT item_id * 1000000 + i AS k, {B.seq_sql('p')} AS seq FROM (
  SELECT item_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (SELECT item_id, regexp_split_to_array(text, '[.!?\\n]+') AS ps FROM benchmark))) WHERE length(seq) BETWEEN 10 AND 50 GROUP BY 1)"""


def _known(t):
    parts = t.benchmark.select("item_id", F.posexplode(F.split("text", B.SENTENCE_END)).alias("i", "raw"))
    seqs = parts.select((c("item_id") * 1000000 + c("i") + 1).alias("k"), S.lenient_clean(c("raw")).alias("known"))
    return seqs.where(S.length_ok(c("known"))).groupBy("known").agg(F.min("k").alias("idx"))


@query("J13_novelty")
def _(t):
    out = SIM.novelty(B.records(t), _known(t))
    return out.select("sequence", "is_novel", S.r6(F.coalesce("max_similarity", F.lit(-1.0))).alias("max_similarity"), F.coalesce("best_match", F.lit("")).alias("best_match"))


@query("J13_novelty_levenshtein", B.with_sql(KNOWN, """
SELECT sequence AS a, known AS b, levenshtein(sequence, known) AS distance FROM (SELECT DISTINCT sequence FROM records) r JOIN known k
  ON abs(length(sequence) - length(known)) <= floor(0.2 * least(length(sequence), length(known)) + 1e-9)
WHERE levenshtein(sequence, known) <= floor(0.2 * least(length(sequence), length(known)) + 1e-9)"""))
def _(t):
    out = SIM.novelty_levenshtein(B.records(t), _known(t))
    return out.select("a", "b", c("distance").cast("long").alias("distance"))


@query("J14_mean_identity", B.with_sql(B.RECORDS, f"""
, s AS MATERIALIZED (SELECT sequence FROM (SELECT DISTINCT sequence FROM records) ORDER BY {B.u_sql(42, 'cap', 'sequence')}, sequence LIMIT 500)
SELECT count(*) AS pairs, {R('avg(1 - levenshtein(a.sequence, b.sequence) / greatest(length(a.sequence), length(b.sequence)))')} AS mean_identity,
  {R('1 - avg(1 - levenshtein(a.sequence, b.sequence) / greatest(length(a.sequence), length(b.sequence)))')} AS diversity FROM s a JOIN s b ON a.sequence < b.sequence""".lstrip()))
def _(t):
    out = SIM.mean_identity(B.records(t), "sequence", 500, 42)
    return out.select("pairs", S.r6(c("mean_identity")).alias("mean_identity"), S.r6(c("diversity")).alias("diversity"))


@query("J15_similarity_clusters")
def _(t):
    return SIM.similarity_clusters(B.records(t), 0.8)
