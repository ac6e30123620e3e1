"""Written intermediate tables, and fixed-size hash bitmaps that thin out rows before a join."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP_BITS = 24
_SEGMENT_BITS = 13


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only for an unset local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="seqlab-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there."""
    path = shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Like ``staged``, dealt by ``column``: a join by it leaves these rows where they are. Its name stays in the catalog."""
    path = shared_folder(df.sparkSession)
    name = f"llm_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(width(df), column).saveAsTable(name)
    return df.sparkSession.table(name)


def width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bit_slots(hashes: np.ndarray) -> np.ndarray:
    """Slot of each 64-bit hash in a bitmap; the top bits, since the low ones choose nothing else here."""
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def hash_bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bitmap (2 MB whatever the input) of the hashes in a long ``column``; members always test true.

    Every task sends only the non-zero 1 kB segments of its own bitmap; segments meet by number.
    """
    size = 1 << _SEGMENT_BITS

    def partial(batches):
        seen = np.zeros(1 << BITMAP_BITS, dtype=bool)
        for batch in batches:
            values = batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
            seen[bit_slots(values)] = True
        rows = seen.reshape(-1, size)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_pydict({"segment": used.astype(np.int32), "bits": [np.packbits(rows[i]).tobytes() for i in used]},
                                         schema=pa.schema([("segment", pa.int32()), ("bits", pa.binary())]))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        joined = np.bitwise_or.reduce(np.stack([np.frombuffer(b, dtype=np.uint8) for b in frame["bits"]]), axis=0)
        return pd.DataFrame({"segment": frame["segment"].iloc[:1], "bits": [joined.tobytes()]})

    parts = df.select(column).mapInArrow(partial, "segment int, bits binary")
    bits = np.zeros((1 << (BITMAP_BITS - _SEGMENT_BITS), size // 8), dtype=np.uint8)
    for row in parts.groupBy("segment").applyInPandas(merge, "segment int, bits binary").collect():
        bits[row["segment"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits.reshape(-1)


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = bit_slots(hashes)
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1


def empty_of(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def training_row(column: str, parts: int):
    """crc32(id as text) mod ``parts`` is not 0; a null id counts as text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(parts)) != 0
