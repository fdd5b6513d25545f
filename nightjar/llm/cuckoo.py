"""Exact dedup over a cuckoo-filter index of live digests.

The filter keeps a 16-bit tag of each live digest in one of two buckets, supports insertion and deletion, and is
rebuilt at twice the size from the stored keys when an insertion finds no room. A tag that hits proves nothing:
the digest is then compared with the content stored for its bucket (SHA-256 of the normalised text), so results
are exact. Tasks use one index of bounded size over their own rows first, evicting (deleting) the oldest digests
when it is full, and a second one over the partial groups dealt by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm._common import partitions, pinned

WHITE_SPACE = r"[\x20\x09-\x0D]+"
SLOTS, KICKS, LIVE = 4, 200, 200_000


class CuckooIndex:
    """Digest (bytes) -> value, behind a cuckoo filter.

    The home bucket comes from the digest's first bytes, the tag from later ones; the other bucket is the home
    bucket xor a hash of the tag, so either leads to the other without the key.
    """

    def __init__(self, buckets: int = 1024):
        self._resize(max(2, 1 << (buckets - 1).bit_length()), {})

    def _resize(self, buckets: int, stored: dict[bytes, object]) -> None:
        while True:
            self.mask = buckets - 1
            self.tags: list[list[int]] = [[] for _ in range(buckets)]
            #: The stored keys by home bucket, with their values: what hits verify against and resizing reads
            self.content: list[dict[bytes, object]] = [{} for _ in range(buckets)]
            self.size = 0
            if all(self._place(*self._home(key)) for key in stored):
                break
            buckets *= 2
        for key, value in stored.items():
            self.content[self._home(key)[0]][key] = value
        self.size = len(stored)

    def _home(self, key: bytes) -> tuple[int, int]:
        return int.from_bytes(key[:6], "little") & self.mask, int.from_bytes(key[6:8], "little")

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995 + 1) & self.mask)

    def _place(self, bucket: int, tag: int) -> bool:
        if len(self.tags[bucket]) < SLOTS:
            self.tags[bucket].append(tag)
            return True
        bucket = self._other(bucket, tag)
        for kick in range(KICKS):
            tags = self.tags[bucket]
            if len(tags) < SLOTS:
                tags.append(tag)
                return True
            victim = kick % SLOTS
            tag, tags[victim] = tags[victim], tag
            bucket = self._other(bucket, tag)
        return False

    def might_hold(self, key: bytes) -> bool:
        home, tag = self._home(key)
        return tag in self.tags[home] or tag in self.tags[self._other(home, tag)]

    def get(self, key: bytes) -> object | None:
        """The value of a live digest: the filter is asked first, and its hits are verified."""
        return self.content[self._home(key)[0]].get(key) if self.might_hold(key) else None

    def insert(self, key: bytes, value: object) -> None:
        """Insert a digest that isn't live, or replace a live one's value."""
        home, tag = self._home(key)
        held = self.content[home]
        if self.might_hold(key) and key in held:
            held[key] = value
            return
        held[key] = value
        self.size += 1
        if not self._place(home, tag):
            self._resize(2 * (self.mask + 1), dict(self.items()))

    def delete(self, key: bytes) -> object | None:
        """Delete a live digest and return its value; None if it isn't live."""
        home, tag = self._home(key)
        if not self.might_hold(key) or key not in self.content[home]:
            return None
        bucket = home if tag in self.tags[home] else self._other(home, tag)
        self.tags[bucket].remove(tag)  # equal tags of one pair of buckets stand for each other
        self.size -= 1
        return self.content[home].pop(key)

    def items(self) -> Iterator[tuple[bytes, object]]:
        for held in self.content:
            yield from held.items()

    def __len__(self) -> int:
        return self.size


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _better(a: tuple, b: tuple) -> tuple:
    """The row that stays: most code points, then the smallest id, null ids last."""
    rank = lambda r: (-r[0], r[1] is None, r[1] or 0)
    return a if rank(a) <= rank(b) else b


def _grouped(live: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, order = CuckooIndex(), []

        for batch in batches:
            for digest, chars, doc, n in zip(*(batch[c].to_pylist() for c in ("digest", "chars", "keep_id", "n")), strict=True):
                held = index.get(digest)
                if held is None:
                    if len(index) >= live:  # make room: the older half goes on, to meet later rows after the shuffle
                        half = max(1, live // 2)
                        yield _groups_batch([(key, *index.delete(key)) for key in order[:half]])
                        del order[:half]
                    index.insert(digest, (chars, doc, n))
                    order.append(digest)
                else:
                    index.insert(digest, (*_better(held[:2], (chars, doc)), held[2] + n))
        if order:
            yield _groups_batch([(key, *index.delete(key)) for key in order])

    return run


def _closing(batches: Iterator[pa.RecordBatch], flush: int = 5000) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by digest: all live digests but the latest are complete, and leave the index in batches."""
    index, order = CuckooIndex(), []

    def leave(upto: int) -> pa.RecordBatch:
        out = [(key, *index.delete(key)) for key in order[:upto]]
        del order[:upto]
        return _groups_batch(out)

    for batch in batches:
        for digest, chars, doc, n in zip(*(batch[c].to_pylist() for c in ("digest", "chars", "keep_id", "n")), strict=True):
            held = index.get(digest)
            if held is None:
                if len(order) >= flush:
                    yield leave(len(order))
                index.insert(digest, (chars, doc, n))
                order.append(digest)
            else:
                index.insert(digest, (*_better(held[:2], (chars, doc)), held[2] + n))
    if order:
        yield leave(len(order))


def _groups_batch(rows: list[tuple]) -> pa.RecordBatch:
    digests, chars, ids, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chars, pa.int64()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["digest", "chars", "keep_id", "n"])


def _groups(rows: DataFrame, live: int) -> DataFrame:
    """(digest, keep_chars, keep_id, group_size) of rows (doc_id, digest, chars)."""
    kind = "digest binary, chars long, keep_id long, n long"
    partial = rows.select("digest", "chars", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")).mapInArrow(_grouped(live), kind)
    dealt = partial.repartition(partitions(rows.sparkSession), "digest").sortWithinPartitions("digest")
    return dealt.mapInArrow(_closing, kind).select("digest", F.col("chars").alias("keep_chars"), "keep_id", F.col("n").alias("group_size"))


def _keys(id_col: str, text_col: str) -> dict[str, Column]:
    text = F.col(text_col)
    return {"doc_id": F.col(id_col).cast("long"), "digest": F.unhex(F.sha2(normalised(text), 256)), "chars": F.length(F.coalesce(text, F.lit(""))).cast("long")}


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", live: int = LIVE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts that are equal without ASCII white space, the row with the most code points stays, then the smallest
    id; rows that repeat the same id and length all count as kept. A null text counts as empty; a null id is
    larger than all others and is kept, with a null keep_id, where no other row of its length or longer is there.
    No text leaves its task: only digests are shuffled. Other columns are not read.
    """
    rows = pinned(docs.select(*[c.alias(n) for n, c in _keys(id_col, text_col).items()]))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return rows.join(_groups(rows, live), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", live: int = LIVE) -> DataFrame:
    """One row of docs, all columns, of each group of equal texts: the one that `exact_groups` keeps.

    Rows are told apart by id and digest, so an id may bear several texts; of rows that repeat both, and of null ids, one stays.
    """
    keyed = docs.withColumns({f"_{n}": c for n, c in _keys(id_col, text_col).items()})
    rows = pinned(docs.select(*[c.alias(n) for n, c in _keys(id_col, text_col).items()]))
    kept = _groups(rows, live).select(F.col("digest").alias("_digest"), "keep_chars", "keep_id")
    stay = keyed.join(kept, "_digest").filter(F.col("_doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_chars") == F.col("keep_chars")))
    return stay.dropDuplicates(["_digest"]).select(*[F.col(f"`{c}`") for c in docs.columns])
