"""Document fingerprints: Order MinHash over occurrence-numbered k-mers of code points.

Every k-mer of a text is numbered by its occurrence, so that repeats are told apart. For each of ``slots`` hash
functions the two (k-mer, occurrence) items with the smallest hashes are selected, put back into text order and
hashed as a tuple. Two texts agree in a slot if they share both items in the same order, which falls with edit
distance and not merely with set overlap. A fingerprint is the slots' tuple hashes as hexadecimal digits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm._common import LONG_MIN, mix64, partitions, range_bounds, range_bucket

SLOTS, KMER, SEED = 64, 8, 20240117
_AT_BITS = 24
_AT, _AT_MASK = np.uint64(_AT_BITS), np.uint64((1 << _AT_BITS) - 1)
_HIGH_MASK = ~_AT_MASK
_HALF = np.uint64(32)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << level, 1 << 64)) for level in range(24)]


@lru_cache
def _functions(slots: int, seed: int) -> np.ndarray:
    """Odd multipliers: x -> x * m is a permutation of the 32-bit numbers."""
    return mix64(np.arange(1, slots + 1, dtype=np.uint64) * _PRIME + np.uint64(seed)).astype(np.uint32) | np.uint32(1)


def _rolled(points: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k-mer, doubling the width while it fits."""
    blocks = [points.astype(np.uint64)]
    while 2 << (len(blocks) - 1) <= k:
        level, h = len(blocks) - 1, blocks[-1]
        wider = h[: -(1 << level)] * _POWERS[level]
        wider += h[1 << level :]
        blocks.append(wider)
    kmers, done, out = len(points) - k + 1, 0, None
    for level in reversed(range(len(blocks))):
        if k - done >= 1 << level:
            piece = blocks[level][done : done + kmers]
            out = piece if out is None else out * _POWERS[level] + piece
            done += 1 << level
    return out


def signature(text: str | None, slots: int = SLOTS, k: int = KMER, seed: int = SEED) -> np.ndarray:
    """The slots' 16-bit tuple hashes. No text and the empty text give zeros; a text under k code points is one k-mer."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points)
    if n == 0:
        return np.zeros(slots, dtype=np.uint16)
    k = min(k, n)
    kmers = n - k + 1
    rolled = mix64(_rolled(points, k))
    if kmers < 1 << _AT_BITS:
        rolled &= _HIGH_MASK
        rolled |= np.arange(kmers, dtype=np.uint64)
        rolled.sort()
        at = (rolled & _AT_MASK).view(np.int64)
        value = rolled >> _AT
    else:
        value = rolled >> _AT
        at = np.argsort(value, kind="stable")
        value = value[at]
    first = np.empty(kmers, dtype=bool)
    first[0] = True
    np.not_equal(value[1:], value[:-1], out=first[1:])
    if not first.all():
        starts = np.flatnonzero(first)
        occurrence = np.arange(kmers) - np.repeat(starts, np.diff(np.append(starts, kmers)))
        value += occurrence.view(np.uint64) * _PRIME
    key = mix64(value)
    short = (key >> _HALF).astype(np.uint32)
    times = _functions(slots, seed)
    out = np.empty(slots, dtype=np.uint16)
    step = max(1, min(slots, (1 << 15) // kmers))  # a block of hash values stays in the processor's cache
    buffer = np.empty((step, kmers), dtype=np.uint32)
    for lo in range(0, slots, step):
        t = times[lo : lo + step]
        hashed = np.multiply(short[None, :], t[:, None], out=buffer[: len(t)])
        rows = np.arange(len(t))
        one = hashed.argmin(axis=1)
        if kmers > 1:
            hashed[rows, one] = 0xFFFFFFFF
            two = hashed.argmin(axis=1)
        else:
            two = one
        swap = at[one] > at[two]
        head, tail = np.where(swap, two, one), np.where(swap, one, two)
        out[lo : lo + step] = mix64(mix64(key[head]) + key[tail] * _PRIME).astype(np.uint16)
    return out


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the square root of the share of equal slots, a slot being a pair of items."""
    return float(np.sqrt(np.count_nonzero(a == b) / len(a)))


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, slots: int = SLOTS, k: int = KMER, seed: int = SEED, buckets: int | None = None) -> DataFrame:
    """Fingerprint every text and its edit with the next text in descending id order (after the last: the first).

    Texts are dealt once, by range of the id, and each task streams through its sorted rows. A bucket's last row
    needs the first row of the next lower bucket, which is sent there too: one more row a bucket.

    A null text counts as empty, a null id as smaller than all others; rows of one id follow in text order, so
    repeated rows are each other's neighbours. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LONG_MIN)))
    count = buckets or 4 * partitions(spark)
    bounds = range_bounds(rows.select(F.col("key").cast("double").alias("key")), "key", count)
    rows = rows.withColumn("bucket", range_bucket(F.col("key"), bounds))
    tops = sorted(rows.groupBy("bucket").agg(F.max("key").alias("key")).collect())  # at most one row a bucket
    if not tops:
        tops = [(0, 0)]
    needed_in = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    guests = spark.createDataFrame(list(needed_in.items()), "key long, to int")
    guest_rows = rows.drop("bucket").join(F.broadcast(guests), "key").select("doc_id", "text", "key", F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    dealt = rows.select("doc_id", "text", "key", "bucket", F.lit(0).alias("guest")).unionByName(guest_rows)
    dealt = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), "text").select("bucket", "guest", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, guest, id, text, signature
        out: list[tuple] = []
        for batch in batches:
            for bucket, guest, doc, text in zip(batch["bucket"].to_pylist(), batch["guest"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                if guest and (held is None or held[1] or held[0] != bucket):
                    held = (bucket, guest, doc, "", None)  # a further row of the guest's id
                    continue
                sig = signature(text, slots, k, seed)
                if held is not None and held[0] == bucket and not held[1]:
                    new = edited(held[3], text)
                    own = held[4]
                    other = signature(new, slots, k, seed)
                    out.append((held[2], len(held[3]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(other), likeness(own, other), likeness(own, sig)))
                held = (bucket, guest, doc, text, sig)
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
