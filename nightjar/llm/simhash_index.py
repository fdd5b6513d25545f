"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes of 3-word shingles; two link at ``within`` or fewer differing bits. Distinct
fingerprints are dealt by pigeonhole keys, so that every linking pair meets in at least one group: of ``blocks``
bit blocks, any ``blocks - within`` are agreed on. A task indexes its groups together: each is sorted by Gray
rank, consecutive fingerprints are bracketed, and the bits that a bracket shares are moved up into its node as a
masked pattern, level by level. A search walks down from the roots, adding the differences met in each node's
pattern, and drops a whole bracket once they exceed the limit. Links found become a forest per task, and the
forests are joined by distributed connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm._common import connected_components, forest, partitions, pinned
from nightjar.llm.near_pairs import by_group

SHINGLE, WITHIN, BLOCKS, FANOUT, SEED = 3, 2, 6, 8, 42
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, least significant first, by counting byte values."""
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BIT_TABLE).ravel()


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text, as an unsigned number; without words 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)
    majority = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's bits in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(t.as_py(), shingle) for t in batch["text"]), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the Gray code's order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class GrayIndex:
    """The hierarchical index over many groups at once. Entries must come sorted by group, then by Gray rank."""

    def __init__(self, patterns: np.ndarray, groups: np.ndarray, fanout: int = FANOUT):
        self.patterns = patterns
        full = np.full(len(patterns), 2**64 - 1, dtype=np.uint64)
        #: From the entries up: (pattern, mask of its shared bits, first child, end of its children)
        self.levels = [(patterns, full, None, None)]
        group, low, high, mask = groups, patterns, patterns, full
        while True:
            new = np.r_[True, group[1:] != group[:-1]]
            starts = np.flatnonzero(new)
            if len(starts) == len(group) and len(self.levels) > 1:
                break
            place = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            heads = np.flatnonzero(place % fanout == 0)
            low, high = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads)
            mask = np.bitwise_and.reduceat(mask, heads) & ~(low ^ high)
            group = group[heads]
            self.levels.append((low & mask, mask, heads, np.r_[heads[1:], len(place)]))
        self.roots = group  # one node for each group

    def search(self, queries: np.ndarray, roots: np.ndarray, within: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, entry number) of all that differ in at most ``within`` bits, in blocks of bounded size."""
        top = len(self.levels) - 1
        pattern, mask, _, _ = self.levels[top]
        spent = np.bitwise_count((queries ^ pattern[roots]) & mask[roots]).astype(np.int8)
        keep = spent <= within
        todo = [(top, np.flatnonzero(keep), roots[keep], spent[keep])]
        while todo:
            level, q, node, spent = todo.pop()
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            _, above, first, end = self.levels[level]
            count = (end - first)[node]
            total = int(count.sum())
            if total > block and len(q) > 1:
                half = len(q) // 2
                todo += [(level, q[:half], node[:half], spent[:half]), (level, q[half:], node[half:], spent[half:])]
                continue
            q2 = np.repeat(q, count)
            child = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[node], count)
            pattern, mask, _, _ = self.levels[level - 1]
            more = np.bitwise_count((queries[q2] ^ pattern[child]) & (mask[child] & ~np.repeat(above[node], count)))
            spent = np.repeat(spent, count) + more.astype(np.int8)
            keep = spent <= within
            todo.append((level - 1, q2[keep], child[keep], spent[keep]))


def block_masks(within: int, blocks: int) -> list[int]:
    """Every mask that keeps ``blocks - within`` of the bit blocks: two patterns within the limit agree under one."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - within)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_links(combo: np.ndarray, key: np.ndarray, patterns: np.ndarray, nodes: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (node, node) within the groups of equal (combo, key)."""
    order = np.lexsort((gray_rank(patterns), key, combo))
    combo, key, patterns, nodes = combo[order], key[order], patterns[order], nodes[order]
    new = np.r_[True, (combo[1:] != combo[:-1]) | (key[1:] != key[:-1])]
    group = np.cumsum(new) - 1
    paired = np.bincount(group)[group] > 1
    if not paired.any():
        return nodes[:0], nodes[:0]
    patterns, nodes, group = patterns[paired], nodes[paired], group[paired]
    group = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    index = GrayIndex(patterns, group)
    parent = np.arange(len(patterns))
    for q, entry in index.search(patterns, group, within):
        later = entry > q
        forest(parent, q[later], entry[later])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return nodes[moved], nodes[parent[moved]]


def links(distinct: DataFrame, within: int = WITHIN, blocks: int = BLOCKS) -> DataFrame:
    """Distinct (fp, node) -> links (a, b) whose components are those of all pairs within the limit.

    With 6 blocks and 2 bits a group agrees on at least 42 bits, so it holds at most 2**22 fingerprints (32 MB)
    at any input size; copies are gone before. Each fingerprint is sent 15 times, as 25 bytes.
    """
    masks = block_masks(within, blocks)
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = distinct.select("fp", "node", F.explode(keys).alias("k")).select("k.combo", "k.key", "fp", "node")
    dealt = dealt.repartition(partitions(distinct.sparkSession), "combo", "key").sortWithinPartitions("combo", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(batches, ["combo", "key"]):
            combo, key, fp, node = (part[c].to_numpy() for c in ("combo", "key", "fp", "node"))
            a, b = group_links(combo, key, fp.view(np.uint64), node, within)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _named(signed: DataFrame, within: int, blocks: int) -> DataFrame:
    """(fp, component) of the distinct fingerprints in signed: a fingerprint is its own node, whatever ids bear it."""
    distinct = pinned(signed.select("fp").distinct().withColumn("node", F.col("fp")))
    component = connected_components(links(distinct, within, blocks))
    return distinct.join(component, "node", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, within: int = WITHIN, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest doc_id reachable over links. Null and wordless texts have fingerprint zero and
    link like any other. A null doc_id counts as larger than all others, so component_id is null where no linked
    row has an id. Repeated rows are returned repeatedly; rows of one id with several texts are each in the component of
    their own text. Other columns are not read; an empty table gives an empty result.
    """
    signed = pinned(fingerprints(docs, id_col, text_col, shingle))
    named = pinned(_named(signed, within, blocks))
    lowest = signed.groupBy("fp").agg(F.min("doc_id").alias("low")).join(named, "fp").groupBy("component").agg(F.min("low").alias("component_id"))
    of = pinned(named.join(lowest, "component").select("fp", "component_id"))  # apart from the last join, so that AQE can split a hot fingerprint
    return signed.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, within: int = WITHIN, blocks: int = BLOCKS) -> DataFrame:
    """One row of docs, with all its columns, of each component: the smallest id (nulls last), then hash of the text.

    So a row without an id stays only if no row with an id is linked to it, and of rows that agree in id and
    text any one stays. An id that bears texts of two components may stay in both.
    """

    @F.arrow_udf("long")
    def signature(text: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((simhash(t.as_py(), shingle) for t in text), dtype=np.uint64, count=len(text)).view(np.int64))

    rank = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text"), F.xxhash64(F.lit(1), text_col).alias("text2"))
    keyed = docs.withColumn("_fp", signature(F.col(text_col))).withColumn("_rank", rank)
    slim = pinned(keyed.groupBy(F.col("_fp").alias("fp")).agg(F.min("_rank").alias("first")))
    firsts = _named(slim, within, blocks).join(slim, "fp").groupBy("component").agg(F.min(F.struct("first", "fp")).alias("first"))
    kept = firsts.select(F.col("first.fp").alias("_fp"), F.col("first.first").alias("_first"))
    return keyed.join(kept, "_fp").filter(F.col("_rank") == F.col("_first")).dropDuplicates(["_fp"]).select(*[F.col(f"`{c}`") for c in docs.columns])
