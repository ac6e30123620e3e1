"""Connected components of a link table, for links that are few against the rows they join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlab.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """(v, c): each vertex of links (a, b) with the smallest vertex it can reach.

    Alternates two star operations until nothing changes: every vertex passes the smallest vertex it knows to
    its larger neighbours, then to its smaller ones. Each round is written to the shared folder. A star's
    centre is found by a map-side minimum and its rows stay rows, so a vertex with many links needs no room.
    """
    def state(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()

    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large.where("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = staged(small.where("a <> b").distinct())
        now = state(after)
        if now == before:  # a round that changes nothing keeps count and checksums
            return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).unionByName(
                edges.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
        edges, before = after, now
