"""Bounded samples of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SLOTS = 1 << 20


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], condition: Column | None = None) -> tuple[DataFrame, dict[int, float]]:
    """About ``rows[c]`` documents (doc_id, text, label) of each class c, chosen by the hash of their id, and the share taken of each.

    The labels are thinned before the join, so what is broadcast has a bound: the sum of ``rows`` expected
    label rows. All label rows of an id count as one, with the largest label.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = (known.where(condition) if condition is not None else known).groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.where(F.col("label").isin(*rows)).groupBy("label").count().collect()}
    shares = {c: min(1.0, n / max(sizes.get(c, 0), 1)) for c, n in rows.items()}
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(_SLOTS))
    chosen = [known.where((F.col("label") == c) & (slot < round(share * _SLOTS))) for c, share in shares.items()]
    both = chosen[0]
    for more in chosen[1:]:
        both = both.unionByName(more)
    return documents.select("doc_id", "text").join(F.broadcast(both), "doc_id").select("doc_id", "text", "label"), shares
