"""Embedding geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import descriptors as D, scalars as S
from ..operators import vectors as V
from . import base as B
from .registry import query

c = F.col
R = B.r6_sql

Z = """x AS (SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INT) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
st AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM x GROUP BY 1),
z AS MATERIALIZED (SELECT vec_id, label, x.dim, (x - m) / sd AS z FROM x JOIN st ON st.dim = x.dim),
cen AS MATERIALIZED (SELECT label, dim, avg(z) AS c, count(*) AS n FROM z GROUP BY ALL),
dist AS MATERIALIZED (SELECT vec_id, z.label, sum((z - c) * (z - c)) AS d2 FROM z JOIN cen ON cen.label = z.label AND cen.dim = z.dim GROUP BY ALL),
sc AS MATERIALIZED (SELECT label, avg(d2) AS within, avg(sqrt(d2)) AS s, sum(d2) AS ss, count(*) AS n FROM dist GROUP BY 1)"""


def _scaled(t):
    df = t.embeddings.select("vec_id", "label", "embedding")
    return V.apply_scaler(df, "embedding", V.fit_scaler(df, "embedding"))


@query("L09_standardise", B.with_sql(Z, f"SELECT vec_id, {R('sum(abs(z))')} AS l1, {R('sum(z * (dim + 1))')} AS weighted, {R('max(z)')} AS top FROM z GROUP BY 1"))
def _(t):
    e = c("embedding")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return _scaled(t).select("vec_id", S.r6(total(F.transform(e, F.abs))).alias("l1"), S.r6(total(F.transform(e, lambda x, i: x * (i + 1)))).alias("weighted"), S.r6(F.array_max(e)).alias("top"))


@query("A34_fisher_separation", B.with_sql(Z, f"""
, d AS (SELECT sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM cen a JOIN cen b ON a.dim = b.dim WHERE a.label = 0 AND b.label = 1), w AS (SELECT max(CASE WHEN label = 0 THEN within END) AS w0, max(CASE WHEN label = 1 THEN within END) AS w1 FROM sc)
SELECT {R('d')} AS centroid_distance, {R('w0')} AS w0, {R('w1')} AS w1, {R('d * d / greatest(w0 + w1, 1e-8)')} AS fisher_ratio FROM d, w""".lstrip()))
def _(t):
    out = V.fisher_separation(V.class_scatter(_scaled(t), "label", "embedding"), "label", 0, 1)
    return out.select(*[S.r6(c(k)).alias(k) for k in out.columns])


@query("A35_cluster_indices", B.with_sql(Z, f"""
, p AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM cen a JOIN cen b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL),
db AS (SELECT avg(r) AS db FROM (SELECT i, max((x.s + y.s) / d) AS r FROM p JOIN sc x ON x.label = i JOIN sc y ON y.label = j GROUP BY 1)),
o AS (SELECT dim, avg(z) AS o FROM z GROUP BY 1),
bt AS (SELECT sum(n * (c - o) * (c - o)) AS b FROM cen JOIN o ON o.dim = cen.dim)
SELECT {R('db')} AS davies_bouldin, {R("b / (SELECT count(*) - 1 FROM sc) / ((SELECT sum(ss) FROM sc) / (SELECT sum(n) - count(*) FROM sc))")} AS calinski_harabasz FROM db, bt""".lstrip()))
def _(t):
    scaled = _scaled(t)
    scatter = V.class_scatter(scaled, "label", "embedding")
    both = V.davies_bouldin(scatter, "label").crossJoin(V.calinski_harabasz(scaled, scatter, "label", "embedding"))  # one row each
    return both.select(*[S.r6(c(k)).alias(k) for k in both.columns])


@query("A36_squared_silhouette", B.with_sql(Z, f"""
, g AS (SELECT z.vec_id, z.label, k.label AS other, sum(z.z * z.z) - 2 * sum(z.z * k.c) AS part FROM z JOIN cen k ON k.dim = z.dim GROUP BY ALL),
q AS (SELECT label, sum(z * z) / count(DISTINCT vec_id) AS q, count(DISTINCT vec_id) AS n FROM z GROUP BY 1),
d AS (SELECT g.vec_id, g.label, other, part + q AS d, n FROM g JOIN q ON q.label = other),
s AS (SELECT vec_id, max(CASE WHEN label = other THEN d * n / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN d END) AS b FROM d GROUP BY 1)
SELECT {R('avg((b - a) / greatest(a, b))')} AS silhouette FROM s""".lstrip()))
def _(t):
    return V.squared_silhouette(_scaled(t), "label", "embedding").select(S.r6(c("silhouette")).alias("silhouette"))


@query("L14_latent_mean", f"""
SELECT label AS id, dim, {R('avg(x)')} AS value FROM (SELECT label, CAST(unnest(range(len(embedding))) AS INT) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL""")
def _(t):
    return D.mean_vector(t.embeddings.withColumnRenamed("label", "id"), ["id"], "embedding").withColumn("value", S.r6(c("value")))
