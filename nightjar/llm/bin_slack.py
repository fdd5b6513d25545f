"""Best-fit packing by minimum bin slack, planned on the histogram of piece lengths.

A sequence is opened with the longest piece left, and bitset subset-sum dynamic programming over the lengths that
are left finds the fullest feasible filling of the rest. That combination is removed as often as the counts
allow, so the plan's size depends on the sequence length alone (at most ``limit`` lengths) and not on the number
of documents: it is made once on the driver from the histogram. Pieces then find their places by their rank among
the pieces of their length.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm._common import global_row_number

LIMIT, END_ID = 4096, 1
#: Words kept by a worker, and the bytes of the longest one kept: together they bound the memory
CACHED, LONGEST = 500_000, 64
VOCABULARY = "word_bpe_49k.json"

class _WordIds(dict):
    """word -> its ids as little-endian 32-bit bytes, encoded when first asked for.

    Two generations: when the young one is full it becomes the old one, and words still in use move back from
    there as they come up. So frequent words stay, and words seen once leave, at bounded memory.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        #: Added tokens are looked for before anything is lowered
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha() and word.islower():  # a-z alone: the normaliser and the pre-tokenizer leave it as it is
                found = [token.id for token in self.merge(word.decode())]
            else:
                found = self.encode(word.decode("utf-8", "replace"), None, False, False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) > LONGEST:
            return ids
        if len(self) >= CACHED // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


_known: dict[str, _WordIds] = {}
_COMBINING = re.compile("[\u0300-\u036f]")
_LAST_STOP = re.compile(rb"([a-z])([,.])(?=[ \n])")


def _token_bytes(path: str):
    """text -> its ids as bytes, for one vocabulary file; the words' ids are kept for a worker's lifetime.

    The vocabulary's pre-tokenizer never crosses ASCII white space, and its normaliser acts within words, so a
    text's ids are its words' ids in turn. It lower-cases, so A-Z are lowered first, which leaves fewer words; not
    in texts with combining marks, which may compose with one case of a letter alone, nor in texts with what may
    be an added token, which stands in one case alone. A comma or full stop
    that ends a word after a-z is a token apart in any case, so it is parted here.
    """
    if path not in _known:
        _known[path] = _WordIds(path)
    look_up = _known[path].__getitem__
    begins = sorted({re.match(r"[^\w\s]*", t).group() or t for t in _known[path].added})  # its signs, which have no case

    def encode(text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        if not any(b in text for b in begins) and not _COMBINING.search(text):
            raw = _LAST_STOP.sub(rb"\1 \2", raw.lower())
        return b"".join(map(look_up, raw.split()))

    return encode


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of every document with its end id, cut only if over ``limit``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _token_bytes(str(path))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                for n, at in enumerate(range(0, len(ids), 4 * limit)):
                    piece = ids[at : at + 4 * limit]
                    for column, value in zip(out, (doc, n, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(capacity: int, left: list[tuple[int, int]]) -> dict[int, int]:
    """Of (length, count) pairs, longest first: the combination of greatest sum up to the capacity.

    Bit s of a bitset says that some combination sums to s; each copy of a length shifts the set and joins it.
    The sets after each step lead back to the combination. Stops as soon as the capacity itself is reached.
    """
    everything, goal = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, steps = 1, []
    for length, count in left:
        if length > capacity:
            continue
        for _ in range(min(count, capacity // length)):
            wider = reach | (reach << length) & everything
            if wider == reach:
                break
            steps.append((length, reach))
            reach = wider
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + 1
            at -= length
    return chosen


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[dict[int, int], int]]:
    """(combination of lengths, times) until no piece is left: each is the fullest that holds the longest piece left."""
    counts = dict(histogram)
    order = sorted(counts, reverse=True)
    out = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        combination = fullest(limit - longest, [(x, counts[x]) for x in order if counts[x]])
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in combination.items())
        for x, n in combination.items():
            counts[x] -= n * times
        out.append((combination, times))
        order = [x for x in order if counts[x]]
    return out


def _intervals(steps: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For every length and step: where its ranks begin, the first sequence, pieces a sequence, the first offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for combination, times in steps:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            rows.append((length, used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is the end id alone. Rows that repeat are packed as often as they occur; a
    null id is packed like any other. Only piece rows (six numbers) are shuffled, never texts or ids. Other
    columns are not read; an empty table gives an empty result.
    """
    cut = pieces(docs, id_col, text_col, vocabulary, limit)
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    numbered = global_row_number(cut, order, "place")
    histogram = {r.length: r.n for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    ahead, before = {}, 0
    for length in sorted(histogram, reverse=True):
        ahead[length] = before
        before += histogram[length]
    first_of = np.zeros(limit + 1, dtype=np.int64)
    for length, n in ahead.items():
        first_of[length] = n
    lengths, begins, sequences, each, offsets = _intervals(plan(histogram, limit))
    big = np.int64(1) << np.int64(46)
    keys = lengths * big + begins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = batch["place"].to_numpy() - first_of[length]
            i = np.searchsorted(keys, length * big + rank, side="right") - 1
            nth = rank - begins[i]
            sequence, offset = sequences[i] + nth // each[i], offsets[i] + nth % each[i] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(sequence), pa.array(offset)], names=names + ["sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
