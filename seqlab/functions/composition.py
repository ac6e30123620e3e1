"""Quality-control descriptors of one sequence column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .scalars import count_chars, is_standard, length_ok

# Thresholds of the quality flags.
TOP1_LIMIT, TOP2_LIMIT, ENTROPY_LIMIT = 0.35, 0.60, 0.60
AUDIT_ENTROPY_LIMIT = 0.55
RUN_LIMIT, GF_LIMIT = 4, 0.35


def fraction(seq: Column, chars: str) -> Column:
    size = F.length(seq)
    return F.when(size > 0, count_chars(seq, chars) / size).otherwise(F.lit(0.0))


def char_counts(seq: Column) -> Column:
    """Counts of every distinct character, largest first."""
    distinct = F.array_distinct(F.filter(F.split(seq, ""), lambda c: c != ""))
    counts = F.transform(distinct, lambda c: F.length(seq) - F.length(F.replace(seq, c, F.lit(""))))
    return F.sort_array(counts, asc=False)


def entropy_norm(counts: Column, size: Column) -> Column:
    """Shannon entropy in nats divided by ln 20."""
    total = F.aggregate(
        counts, F.lit(0.0),
        lambda acc, n: acc - (n / size) * F.log(n / size),
    )
    return F.when(size > 0, total / math.log(20)).otherwise(F.lit(0.0))


def longest_run(seq: Column) -> Column:
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, char: Column) -> Column:
        run = F.when(char == acc["last"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(char.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    chars = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda acc: acc["best"])


def simple_charge(seq: Column) -> Column:
    return count_chars(seq, "KR") + 0.1 * count_chars(seq, "H") - count_chars(seq, "DE")


def with_qc(df, seq: str = "sequence", entropy_limit: float = ENTROPY_LIMIT):
    """Attach the whole quality vector. Counts and run are computed once, then reused."""
    s = F.col(seq)
    size = F.length(s)
    base = df.withColumn("_counts", char_counts(s)).withColumn("longest_run", longest_run(s))
    counts = F.col("_counts")
    top = lambda n: F.when(
        size > 0, F.aggregate(F.slice(counts, 1, n), F.lit(0), lambda a, x: a + x) / size
    ).otherwise(F.lit(0.0))
    base = base.select(
        "*",
        size.alias("length"),
        is_standard(s).alias("standard"),
        length_ok(s).alias("valid_length"),
        F.startswith(s, F.lit("M")).alias("m_start"),
        F.contains(s, F.lit("C")).alias("contains_c"),
        fraction(s, "C").alias("c_fraction"),
        top(1).alias("top1_fraction"),
        top(2).alias("top2_fraction"),
        entropy_norm(counts, size).alias("entropy_norm"),
        fraction(s, "GF").alias("gly_phe_fraction"),
        fraction(s, "KRH").alias("basic_fraction"),
        fraction(s, "DE").alias("acidic_fraction"),
        fraction(s, "FWY").alias("aromatic_fraction"),
    ).drop("_counts")
    low = (
        (F.col("top1_fraction") >= TOP1_LIMIT)
        | (F.col("top2_fraction") >= TOP2_LIMIT)
        | (F.col("entropy_norm") <= entropy_limit)
    )
    base = base.select(
        "*",
        low.alias("low_complexity"),
        (F.col("longest_run") >= RUN_LIMIT).alias("homopolymer"),
        (F.col("gly_phe_fraction") >= GF_LIMIT).alias("gf_rich"),
    )
    good = (
        F.col("standard") & F.col("valid_length")
        & ~F.col("low_complexity") & ~F.col("homopolymer") & ~F.col("gf_rich")
    )
    return base.withColumn("qc_pass", good)
