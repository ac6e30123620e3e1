"""Hilbert-curve sharding: rows near each other in several metadata dimensions share a shard.

Each dimension is quantised into ``2 ** bits`` cells of about equal depth, the cell of a row becomes one
index on the Hilbert curve, rows are ordered by that index, and the order is cut into runs of equal row
counts. A reader that filters on any of the dimensions can then skip most files by their minima and maxima.

Only metadata is moved: the order is a range partition of narrow rows, positions are places inside a
partition plus the sizes of the partitions before it, and no window spans the whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from seqlab.llm.staging import staged
from seqlab.operators.ranking import global_position

#: Leading characters of a text dimension that its cell bounds look at; the order of equal prefixes is left to the tie-breakers.
KEY_CHARACTERS = 6
#: Names that the columns of documents do not use.
ROW, SHARD, SLOT = "_seqlab_row", "_seqlab_shard", "_seqlab_slot"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of an (n, dims) array of ``bits``-bit cells.

    From the top bit down, the cell's bit in each dimension either reflects the lower bits of the first
    dimension or swaps them with its own; the Gray code of what is left, read across dimensions, is the index.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            reflect = (x[d] & top) != 0
            exchange = np.where(reflect, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(reflect, low, exchange)
            x[d] ^= exchange
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    carry = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        carry ^= np.where(x[dims - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= carry
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> level) & 1)
    return index


def text_key(column: Column) -> Column:
    """A number that orders as the first characters of a text (code points up to 65535; later ones count as that)."""
    padded = F.rpad(F.substring(F.coalesce(column, F.lit("")), 1, KEY_CHARACTERS), KEY_CHARACTERS, "\0")
    key = F.lit(0.0)
    for i in range(1, KEY_CHARACTERS + 1):
        key = key * 1024.0 + F.least(F.ascii(F.substring(padded, i, 1)), F.lit(1023))
    return key


def _cell(column: Column, bounds: list[float]) -> Column:
    return F.aggregate(F.lit(bounds).cast("array<double>"), F.lit(0), lambda n, b: n + (column > b).cast("int"))


def hilbert_order(df: DataFrame, dimensions: dict[str, Column], ties: list[str], bits: int = 5) -> DataFrame:
    """``df`` with ``curve`` (index) and ``position`` (0, 1, ... along the curve, equal cells by ``ties``)."""
    numbers = staged(df.select("*", *[F.coalesce(c.cast("double"), F.lit(-1.0)).alias(f"_d{i}") for i, c in enumerate(dimensions.values())]))
    names = [f"_d{i}" for i in range(len(dimensions))]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    # a few dozen numbers per dimension reach the driver; as literals they are the same for every retry
    bounds = numbers.agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).first()

    @pandas_udf("bigint")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cells.to_numpy(), bits))

    cells = F.struct(*[_cell(F.col(n), sorted(set(bounds[n] or []))).alias(n) for n in names])
    placed = numbers.withColumn("curve", index(cells)).drop(*names)
    return global_position(placed, [F.col("curve"), *map(F.col, ties)]).withColumn("position", F.col("position") - 1)


def shard_documents(documents: DataFrame, shards: int = 40) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve.

    Dimensions: lang, source and text size. Counts of shards differ by one row at most; with fewer rows than
    shards some are empty. Null texts have size 16 and the checksum of no bytes; null metadata counts as
    empty; null and repeated ids and equal rows are ordered by checksum, then arbitrarily, and each get their
    own slot. Other columns are ignored.
    """
    return _assigned(documents.withColumn(ROW, F.monotonically_increasing_id()), documents.count(), shards).drop("row")


def _assigned(numbered: DataFrame, total: int, shards: int) -> DataFrame:
    """``shard_documents`` of ``total`` documents numbered by ``ROW``, with that number as ``row``."""
    text = F.coalesce("text", F.lit(""))
    rows = numbered.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                            F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col(ROW).alias("row"))
    dimensions = {"lang": text_key(F.col("lang")), "source": text_key(F.col("source")), "size": F.log2("size")}
    ordered = hilbert_order(rows, dimensions, ["lang", "source", "text_crc32", "doc_id", "row"])
    base, extra = divmod(total, shards)
    # the first ``extra`` shards hold one row more
    head = extra * (base + 1)
    position = F.col("position")
    late = F.lit(extra) + F.floor((position - head) / max(base, 1))
    shard = F.when(position < head, F.floor(position / (base + 1))).otherwise(late).cast("int")
    slot = F.when(position < head, position % (base + 1)).otherwise((position - head) % max(base, 1)).cast("long")
    return ordered.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"),
                          F.lit(None).cast("int").alias("grown_shard"), "curve", "row")


def write_shards(documents: DataFrame, path: str, shards: int = 40) -> None:
    """Write the documents as one folder per shard, in slot order inside it.

    Each row is written once, whatever its id: rows are numbered on a staged copy and meet their slots by that number.
    """
    numbered = staged(documents.withColumn(ROW, F.monotonically_increasing_id()))
    assigned = _assigned(numbered, numbered.count(), shards).select(F.col("row").alias(ROW), F.col("shard").alias(SHARD), F.col("slot").alias(SLOT))
    placed = numbered.join(assigned, ROW).repartitionByRange(SHARD, SLOT).sortWithinPartitions(SHARD, SLOT)
    placed.drop(ROW, SLOT).withColumnRenamed(SHARD, "shard").write.partitionBy("shard").parquet(path)
