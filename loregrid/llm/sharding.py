"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

When shards are appended, a key either stays or moves to one of the new shards.

Defined results: the size of a text is its UTF-8 bytes plus one, 1 for a null or empty text, whose crc32
is 0; a null key is a key like any other; repeated rows give repeated rows, in the same shard, with slots
of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a shard within which slots are numbered; a shard's rows divided by this make one sort.
PARTS = 4096
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among ``shards``."""
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    jumped = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = jumped[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        jumped[live] = ((at[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[jumped[live] < shards]
    return at


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; slots count from 0 in each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(jump(keys, shards).astype(np.int32)), pa.array(jump(keys, shards + 1).astype(np.int32)), b.column(1)], names=["id", "size", "text_crc32", "shard", "grown_shard", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(id_col)).alias("key"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    ).mapInArrow(run, f"id {kind}, size long, text_crc32 long, shard int, grown_shard int, key long")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", F.lit(7)), F.lit(PARTS)).cast("int"))
    # At most shards * PARTS rows, whatever the input: they may be numbered in a window and broadcast.
    sums = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "id", "text_crc32", "size")) - 1
    out = rows.withColumn("nth", slot).join(F.broadcast(before), ["shard", "part"])
    return out.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"), "grown_shard"
    )
