"""Byte-level BPE, encoding and decoding, with a hierarchical-bitmap queue of merge ranks.

A pre-token's bytes are a linked list of tokens. Every neighbouring pair that the ranks know waits in the bucket of
its rank, which holds the places of left partners, least first. A bitmap has a bit for each bucket that isn't
empty, and above it one bit for every 64 of the level below, so that find-first-set on three or four words gives the next
rank in constant time whatever the pre-token's length. A place whose pair has changed since it was put there is
stale and skipped. The least rank goes first and of equal ranks the leftmost place, as in the sequential definition.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "byte_bpe_50k.tiktoken"
#: Strings kept by a worker in each of two generations, between batches, and the length of the longest one kept: together they bound the memory
CACHED, LONGEST = 120_000, 48
#: Rows of a batch, and the bytes after which it ends
ROWS, BYTES = 10_000, 4_000_000
#: Bits to a word of the bitmap
WIDTH = 6


class RankBitmap:
    """A set of ranks below ``size`` with add, discard and first in the number of levels (three for 2**18 ranks)."""

    def __init__(self, size: int):
        self.levels: list[list[int]] = []
        while True:
            size = (size + (1 << WIDTH) - 1) >> WIDTH
            self.levels.append([0] * max(size, 1))
            if size <= 1:
                break

    def add(self, rank: int) -> None:
        for words in self.levels:
            at = rank >> WIDTH
            before = words[at]
            words[at] = before | 1 << (rank & 63)
            if before:
                return  # the bits above are set
            rank = at

    def discard(self, rank: int) -> None:
        for words in self.levels:
            at = rank >> WIDTH
            words[at] &= ~(1 << (rank & 63))
            if words[at]:
                return
            rank = at

    def first(self) -> int:
        """The smallest rank in the set, or -1."""
        if not self.levels[-1][0]:
            return -1
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            at = at << WIDTH | (word & -word).bit_length() - 1
        return at


class Merger:
    """The merges of one rank file; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.of_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.shift = max(ranks.values()).bit_length()
        pairs = [
            (ranks[token[:cut]] << self.shift | ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        #: (left id, right id) in one number, rising, and the ranks of both together
        self.keys, self.values = np.array(sorted(pairs) or [(-1, -1)]).T.copy()
        self.waiting = RankBitmap(1 << self.shift)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens, each by itself: they are one list with bounds that no pair crosses, and share the queue."""
        whole = [self.ranks.get(piece, -1) for piece in pieces]
        split = [piece for piece, rank in zip(pieces, whole, strict=True) if rank < 0 and piece]
        merged = iter(self._merge(split) if split else ())
        return [struct.pack("<I", rank) if rank >= 0 else next(merged) if piece else b"" for piece, rank in zip(pieces, whole, strict=True)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, or -1."""
        wanted = left << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.values[at], -1)

    def _merge(self, pieces: list[bytes]) -> Iterator[bytes]:
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        count = len(raw)
        # place `count` stands for what is beyond a bound: it has no token
        ids = np.append(self.single[raw], -1)
        after, before = np.arange(1, count + 2), np.arange(-1, count)
        after[ends - 1] = count
        before[np.concatenate([[0], ends[:-1]])] = count
        pair = np.append(self.of_bytes[raw[:-1], raw[1:]], [-1, -1])
        pair[ends - 1] = -1
        buckets: dict[int, list[np.ndarray]] = {}
        self._wait(np.flatnonzero(pair >= 0), pair, buckets)
        while (rank := self.waiting.first()) >= 0:
            waited = buckets.pop(rank)
            self.waiting.discard(rank)
            waited = waited[0] if len(waited) == 1 else np.sort(np.concatenate(waited))
            waited = waited[pair[waited] == rank]  # the others are stale
            if not len(waited):
                continue
            at, right = waited, after[waited]
            follows = at[1:] == right[:-1]
            if follows.any():  # in a run of overlapping pairs every second one is merged
                start = np.flatnonzero(np.append(True, ~follows))
                turn = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at, right = at[turn % 2 == 0], right[turn % 2 == 0]
            beyond, left = after[right], before[at]
            joined = np.append(False, left[1:] == right[:-1])  # the left neighbour is merged just before
            to_left = self.rank_of(np.where(joined, rank, ids[left]), np.full(len(at), rank))
            to_right = self.rank_of(np.full(len(at), rank), ids[beyond])
            lower = (to_left >= 0) & (to_left < rank) | (to_right >= 0) & (to_right < rank)
            if lower.any():  # a smaller rank comes up: in its pre-token it goes before the rest of this bucket
                owner = np.searchsorted(ends, at, "right")
                earlier = np.cumsum(lower) - lower
                fresh = np.append(True, owner[1:] != owner[:-1])
                now = earlier == np.maximum.accumulate(np.where(fresh, earlier, 0))
                held = np.searchsorted(ends, waited, "right")
                stop = np.full(len(ends), count)
                stop[owner[lower & now]] = at[lower & now]
                rest = waited[waited > stop[held]]
                if len(rest):
                    buckets[rank] = [rest]
                    self.waiting.add(rank)
                at, right, beyond = at[now], right[now], beyond[now]
            ids[at], ids[right], pair[right] = rank, -1, -1
            after[at], before[beyond] = beyond, at
            left = before[at]
            pair[at] = self.rank_of(ids[at], ids[beyond])
            left = left[(left < count) & np.append(True, left[1:] != at[:-1])]
            pair[left] = self.rank_of(ids[left], np.full(len(left), rank))
            self._wait(np.concatenate([at, left]), pair, buckets)
        left = ids[:count]
        alive = left >= 0
        packed, counts = left[alive].astype("<u4").tobytes(), np.cumsum(alive)[ends - 1].tolist()
        at = 0
        for upto in counts:
            yield packed[4 * at : 4 * upto]
            at = upto

    def _wait(self, places: np.ndarray, pair: np.ndarray, buckets: dict[int, list[np.ndarray]]) -> None:
        """Put places into the buckets of their pairs' ranks."""
        ranks = pair[places]
        order = np.lexsort((places, ranks))
        order = order[np.searchsorted(ranks[order], 0) :]
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        firsts = ranks[np.append(0, cuts)].tolist() if len(ranks) else []
        bounds = [0, *cuts.tolist(), len(ranks)]
        for rank, begin, end in zip(firsts, bounds, bounds[1:]):  # noqa: B905  no bounds without ranks
            if rank in buckets:
                buckets[rank].append(places[begin:end])
            else:
                buckets[rank] = [places[begin:end]]
                self.waiting.add(rank)


#: White space beside white space: where there is none, every space and newline starts a pre-token
_SPACE_RUN = re.compile(r"\s\s")
#: A stop or comma between a letter and white space is a pre-token
_MARK = re.compile(r"(?<=[A-Za-z])([,.])(?=[ \n])")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Coder:
    """Text to ids, for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        self.merger = Merger(read_ranks(path))
        self.split = regex.compile(pattern).findall
        #: Two generations of what has been met: what is asked for moves on from the old one, the rest goes with it
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Whether texts may be cut as the public pattern would
        self.by_space = pattern == public_tokenizers.PATTERN

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian and unsigned, four bytes each.

        Under the public pattern a text without white space in a row is cut at spaces, newlines and marks first: a space
        starts a pre-token whatever is before it, a newline is one, and what is between them recurs. What the worker
        hasn't met is split by the pattern, and the new pre-tokens of all texts go through one queue.
        """
        if len(self.new) > CACHED:
            self.old, self.new = self.new, {}
        cut = [(self._chunks if self.by_space else self.split)(text) for text in texts]
        parts, apart = {}, set()
        for chunk in self._missing(set(chain.from_iterable(cut))):
            plain = chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha())
            part = (chunk,) if plain or not self.by_space else self.split(chunk)
            if len(part) > 1 or len(chunk) > LONGEST:
                parts[chunk] = part
                apart.update(part)
            else:
                apart.add(chunk)
        pieces = list(self._missing(apart))
        found = dict(zip(pieces, self.merger.encode([p.encode("utf-8", "surrogatepass") for p in pieces]), strict=True))
        long = {p: found.pop(p) for p in [p for p in pieces if len(p) > LONGEST]}
        self.new.update(found)
        known = self.new.__getitem__
        if long:
            known = (self.new | long).__getitem__
        for chunk, part in parts.items():
            (long if len(chunk) > LONGEST else self.new)[chunk] = b"".join(map(known, part))
        if long:
            known = (self.new | long).__getitem__
        return [b"".join(map(known, chunks)) for chunks in cut]

    def _missing(self, keys: set[str]) -> set[str]:
        """Keys that haven't been met; the others are in the new generation afterwards."""
        keys = keys.difference(self.new)
        again = keys.intersection(self.old)
        self.new.update((key, self.old[key]) for key in again)
        return keys - again

    def _chunks(self, text: str) -> list[str]:
        if "\0" in text or _SPACE_RUN.search(text):
            return [text]
        return _MARK.sub("\0\\1", text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


@cache
def coder(path: str, pattern: str) -> Coder:
    """The coder of a worker, made once and kept."""
    return Coder(path, pattern)


@cache
def tokens(path: str) -> dict[int, bytes]:
    """Id -> bytes, read once by a worker."""
    return {rank: token for token, rank in read_ranks(path).items()}


def text_bytes(ids: bytes, of: dict[int, bytes]) -> bytes:
    """The bytes of packed ids."""
    return b"".join(map(of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of at most ROWS rows each, which end once a column has BYTES bytes."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES)) + 1
        upto = min(upto, at + ROWS, batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """id_col, n_tokens, ids: the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded by itself, without special tokens. A null text counts as empty and has no
    ids. Rows are taken one by one, so repeated rows and ids, null ids and ids of any type stay as they are; other columns
    are not read. Memory is that of a batch, the longest pre-token and two caches of bounded size.
    """
    path = str(ranks or public_tokenizers.path(RANKS))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = coder(path, pattern).encode
        for whole in batches:
            for batch in slices(whole, "_text"):
                ids = to_ids([text or "" for text in batch["_text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    return rows.mapInArrow(run, kind)


def decode(encoded: DataFrame, ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """The rows with `decoded` (binary): the bytes of packed ids. Null ids give null, an id that the file lacks is an error."""
    path = str(ranks or public_tokenizers.path(RANKS))
    kind = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokens(path)
        for whole in batches:
            for batch in slices(whole, ids_col):
                texts = [None if ids is None else text_bytes(ids, of) for ids in batch[ids_col].to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, kind)
