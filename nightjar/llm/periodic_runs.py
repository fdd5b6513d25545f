"""Periodic runs in the words of texts, by recompression.

A run is a stretch of consecutive words of smallest period q that can't be extended keeping q. Candidates come
from a harmonic grid: a run of period q has every word equal to the one q later over at least 2q places, so one of each
q-th places (of fewer, where the least length asks more) lies in it with q equal words after it; a few words decide whether a
place stays a candidate. How far it extends to both sides is answered exactly by longest common extension on a
run-length grammar: levels that alternately replace blocks of one symbol, and pairs across a random bipartition of the symbols.
Equal stretches get equal symbols but for their ends, so an extension climbs while both sides start a symbol of
the next level, and comes down to the first word that differs: a number of steps in the logarithm of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm._common import mix64

#: Least length and exponent of a run
LENGTH, EXPONENT = 24, 3
#: Words taken together (one longer text is taken by itself), and extensions asked for at once
WORDS, ASKED = 400_000, 200_000
#: A grammar ends with so many symbols, or two a text
TOP = 64

RUN = "struct<start: long, length: long, period: long>"


class Grammar:
    """The levels of a run-length grammar over symbols, and extensions to both sides.

    Level 0 is the sequence; `first[k]` has where each symbol of level k + 1 starts in level k (and the end of it), `above[k]`
    which symbol of level k + 1 a place of level k is in, and `block[k]` whether that level's symbols are blocks.
    """

    def __init__(self, symbols: np.ndarray, top: int = TOP):
        self.levels, self.first, self.above, self.block = [symbols], [], [], []
        names, rounds = int(symbols.max(initial=0)) + 1, 0
        while len(self.levels[-1]) > top and rounds < 200:
            for blocks in (True, False):
                line = self.levels[-1]
                if blocks:
                    starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                    sizes = np.diff(np.append(starts, len(line)))
                    joined, second = sizes > 1, sizes
                else:
                    side = mix64(line.astype(np.uint64) + np.uint64((2 * rounds + 1) << 40)) & np.uint64(1)
                    if ((side[:-1] == 0) & (side[1:] == 1)).sum() < ((side[:-1] == 1) & (side[1:] == 0)).sum():
                        side = 1 - side
                    into = np.append(False, (side[:-1] == 0) & (side[1:] == 1))  # goes into the pair that the one before opens
                    starts = np.flatnonzero(~into)
                    joined = np.append(into[1:], False)[starts]
                    second = line[np.minimum(starts + 1, len(line) - 1)]
                if not joined.any():
                    continue
                lifted = line[starts]
                keys = lifted[joined] * np.int64(max(names, len(line) + 1)) + second[joined]
                lifted[joined] = names + pd.factorize(keys)[0]
                codes, found = pd.factorize(lifted)  # names stay small, so that two of them fit into a key
                self.levels.append(codes)
                names = len(found)
                self.first.append(np.append(starts, len(line)))
                above = np.zeros(len(line), np.int64)
                above[starts] = 1
                self.above.append(np.cumsum(above) - 1)
                self.block.append(blocks)
            rounds += 1

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from places a and b on are equal; the sequence must end in a symbol that occurs once."""
        return self._extend(a, b, 1)

    def back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before places a and b are equal; the sequence must begin with a symbol that occurs once."""
        return self._extend(a - 1, b - 1, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        left, right = a.copy(), b.copy()  # places in the level that a question has come to
        at = np.zeros(len(a), np.int64)  # the level at which two symbols differ
        going = np.arange(len(a))
        for k in range(len(self.levels)):
            last = k == len(self.levels) - 1
            still = going
            climbs = []
            while len(still):
                x, y = left[still], right[still]
                if not last:
                    up_x, up_y = self.above[k][x], self.above[k][y]
                    edge_x, edge_y = (self.first[k][up_x], self.first[k][up_y]) if way > 0 else (self.first[k][up_x + 1] - 1, self.first[k][up_y + 1] - 1)
                    whole = (edge_x == x) & (edge_y == y)
                    rising = still[whole]
                    left[rising], right[rising] = up_x[whole], up_y[whole]
                    climbs.append(rising)
                    still, x, y = still[~whole], x[~whole], y[~whole]
                equal = self.levels[k][x] == self.levels[k][y]
                at[still[~equal]] = k
                self._step(k, still[equal], left, right, way)
                still = still[equal]
            going = np.concatenate(climbs) if climbs else going[:0]
        for k in reversed(range(1, len(self.levels))):  # down again, to the first symbols that differ
            here = np.flatnonzero(at == k)
            if not len(here):
                continue
            bounds, shift = self.first[k - 1], 0 if way > 0 else 1
            left[here], right[here] = bounds[left[here] + shift] - shift, bounds[right[here] + shift] - shift
            at[here] = k - 1
            while len(here):
                here = here[self.levels[k - 1][left[here]] == self.levels[k - 1][right[here]]]
                self._step(k - 1, here, left, right, way)
        return (left - a) * way

    def _step(self, k: int, which: np.ndarray, left: np.ndarray, right: np.ndarray, way: int) -> None:
        """One equal symbol on, or within two blocks what the shorter one has left."""
        if k < len(self.block) and self.block[k]:
            x, y = left[which], right[which]
            if way > 0:
                rest = np.minimum(self.first[k][self.above[k][x] + 1] - x, self.first[k][self.above[k][y] + 1] - y)
            else:
                rest = np.minimum(x - self.first[k][self.above[k][x]], y - self.first[k][self.above[k][y]]) + 1
        else:
            rest = 1
        left[which] += way * rest
        right[which] += way * rest


def _candidates(line: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid places with equal words ahead; texts lie in ``line`` from the longest to the shortest."""
    places, periods = [], []
    for q in range(1, int(sizes[0]) // EXPONENT + 1) if len(sizes) else ():
        texts = int(np.searchsorted(-sizes, -max(EXPONENT * q, LENGTH), "right"))
        if not texts:
            break
        upto = int(begins[texts - 1] + sizes[texts - 1])
        ahead = max(LENGTH - q, (EXPONENT - 1) * q)  # in a run at least so many words in a row equal those q later
        grid = max(ahead // 2, 1)
        sure = ahead - grid + 1  # as many of them follow some place of the grid
        x = np.flatnonzero(line[:upto:grid][: -(-(upto - q) // grid)] == line[q:upto:grid]) * grid
        for probe in {min(1, sure - 1), sure // 2, sure - 1}:
            if not len(x):
                break
            x = x[x + probe + q < upto]
            x = x[line[x + probe] == line[x + probe + q]]
        if len(x):
            places.append(x)
            periods.append(np.full(len(x), q))
    return (np.concatenate(places), np.concatenate(periods)) if places else (np.empty(0, np.int64),) * 2


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Per text (whole numbers that stand for its words): its runs as rows of start, length, period, by start, then period."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    chosen = [i for i in range(len(texts)) if len(texts[i]) >= LENGTH]
    chosen.sort(key=lambda i: -len(texts[i]))
    if not chosen:
        return out
    sizes = np.array([len(texts[i]) for i in chosen])
    begins = np.cumsum(sizes + 1) - sizes  # a bound before each text and one after the last, none like another
    top = max(int(texts[i].max()) for i in chosen) + 1
    line = np.empty(int(sizes.sum()) + len(sizes) + 1, np.int64)
    line[0] = top
    for n, (i, begin, size) in enumerate(zip(chosen, begins.tolist(), sizes.tolist(), strict=True), 1):
        line[begin : begin + size], line[begin + size] = texts[i], top + n
    places, periods = _candidates(line, sizes, begins)
    if not len(places):
        return out
    # the grammar is over texts with candidates alone
    owner = np.searchsorted(begins, places, "right") - 1
    used = np.unique(owner)
    inside = (begins[owner] <= places) & (places + periods < begins[owner] + sizes[owner])
    owner, places, periods = np.searchsorted(used, owner[inside]), places[inside], periods[inside]
    starts = np.cumsum(sizes[used] + 1) - sizes[used]
    places = places + (starts - begins[used])[owner]
    line = np.concatenate([line[:1], *(line[begins[u] : begins[u] + sizes[u] + 1] for u in used)])
    grammar = Grammar(pd.factorize(line)[0], max(TOP, 2 * len(used)))
    found = []
    for at in range(0, len(places), ASKED):
        x, q, of = (v[at : at + ASKED] for v in (places, periods, owner))
        begin, end = x - grammar.back(x, x + q), x + q + grammar.ahead(x, x + q)
        real = end - begin >= np.maximum(LENGTH, EXPONENT * q)
        found.append(np.unique(np.stack([of, begin - starts[of], (end - begin), q], 1)[real], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    if len(rows):  # of one stretch the smallest period stays: the others are its multiples
        rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
            out[chosen[used[part[0, 0]]]] = part[:, 1:]
    return out


def kept_words(size: int, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays: not one that some run has after its first period."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks)[:size] == 0


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows that are taken together."""
    begin, words = 0, 0
    for i, size in enumerate(sizes):
        if words and words + size > WORDS:
            yield begin, i
            begin, words = i, 0
        words += size
    if begin < len(sizes):
        yield begin, len(sizes)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, runs (array of start, length, period by start, then period), collapsed (text).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, numbered from 0. `collapsed` has the words that no run holds
    after its first period, joined by one space. A null or empty text has no words, no runs and an empty collapsed text. Rows are
    taken one by one, so repeated rows and null ids stay; other columns are not read. Memory is that of WORDS words or of the longest text.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    run = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    kind = T.StructType([rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("runs", run), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(text.as_buffer() or b"") // 5 if text.is_valid else 0 for text in batch["_text"]]
            for begin, end in _groups(sizes):
                part, known = batch.slice(begin, end - begin), {}
                words = [(text or "").encode("utf-8", "surrogatepass").split() for text in part["_text"].to_pylist()]
                number = known.setdefault
                found = runs_of([np.fromiter((number(w, len(known)) for w in ws), np.int64, len(ws)) for ws in words])
                left = [b" ".join(ws) if not len(r) else b" ".join([w for w, k in zip(ws, kept_words(len(ws), r), strict=True) if k]) for ws, r in zip(words, found, strict=True)]
                flat = np.concatenate(found)
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, words), pa.int64()), pa.ListArray.from_arrays(offsets, values), pa.array(left, pa.binary()).cast(pa.string())],
                    names=[id_col, "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(work, kind)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equal ones that of smallest start, then period. Null without runs."""
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text: of each tenth document by crc32 of its decimal id, words that repeat from some place on; other texts as they are.

    With h the crc32, g = h div 10, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8), word i >= a becomes word a + (i - a) % p.
    """
    word, hash_ = r"[^\x20\x09-\x0D]+", F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"), hash_.alias("_h"))
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("_text", F.lit(word), F.lit(0))))
    g, n = F.expr("_h div 10"), F.size("_words").cast("long")
    rows = rows.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.lit(1) + F.expr("(size(_words) - _a) div (3 + (_h div 10) % 8)"))
    tail = F.transform(F.sequence(F.lit(0), F.size("_words") - F.col("_a").cast("int") - 1), lambda i: F.get("_words", (F.col("_a") + i % F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return rows.select(F.col(id_col), F.when(n > 0, text).otherwise(F.col("_text")).alias("text"))
