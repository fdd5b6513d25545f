"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in (id, size, checksum) order, the number is permuted by a keyed Feistel network over
the smallest even-bit domain that holds N, walking on until the value is under N again, and the permuted number p
gives shard p mod shards and slot p div shards. Counts differ by at most one and slots have no gaps. Given N and
the seed any row's shard and slot can be computed, and inverted, without looking at other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm._common import global_row_number, mix64

ROUNDS, SHARDS, SEED = 6, 40, 20240117


def _round_keys(seed: int, rounds: int) -> np.ndarray:
    return mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    for key in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (mix64(left + key) & low), left
        else:
            left, right = right, left ^ (mix64(right + key) & low)
    return (left << np.uint64(half)) | right


def permute(x: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse), walking along cycles of the power-of-two domain."""
    half, keys = _half_bits(n), _round_keys(seed, rounds)
    out = _network(x.astype(np.uint64), half, keys, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, keys, back)
    return out.astype(np.int64)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: shards' row counts are at most one apart. size is the text's UTF-8 bytes plus 16; a null
    text has no bytes and checksum 0. Rows of equal id, size and checksum are interchangeable, so reruns over any
    partitioning agree as a set. Null ids come first. Only ids, sizes and checksums are shuffled. grown_shard is
    null, as this law moves rows when a shard is added. Other columns are not read; no rows give none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = global_row_number(rows, [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")], "row_number")
    total = numbered.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permute(batch["row_number"].to_numpy(), total, seed)
            shard, slot = pa.array((at % count).astype(np.int32)), pa.array(at // count)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["size"], batch["text_crc32"], shard, slot], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    placed = numbered.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
