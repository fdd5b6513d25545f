"""Candidate pairs among rows that share a key: dealt by key, compared by fingerprint within a key's group.

A group of up to ``hot`` rows is compared where it is. A larger one isn't: its rows are cut into pieces of half as many, and
dealt anew for every two of these, over many tasks, so that all its rows meet and no task compares the whole group.

A group over ``BIG`` first gives pairs that connect it. If some of these fail the caller's test, the group's components
are known from the others, and ``across`` tests all pairs of different components where the group is.

Rows may come ``packed``: those of a bucket of keys as one string of bytes, so that Spark deals few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.llm._common import forest, mix64, partitions, stored

ROWS = "key long, node long, n int, fp long, fp2 long"
PACKED = "bucket int, rows binary"
_ROW = np.dtype([("key", "<i8"), ("node", "<i8"), ("n", "<i4"), ("fp", "<i8"), ("fp2", "<i8")])
#: Buckets for each partition and at least, rows that a task packs at once
_BUCKETS, _PACK = (4, 1024), 100_000
HOT, BIG, TIGHT, NEAREST = 30_000, 24, 4, 3

Many = Callable[[list[str], list[str], float], np.ndarray]
Pairing = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def by_group(batches: Iterator[pa.RecordBatch], by: list[str], enough: int = 100_000) -> Iterator[pa.Table]:
    """Columns of whole runs of equal ``by``, in pieces of about ``enough`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [whole[c].to_numpy() for c in by]
        cut = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in columns])))
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        rows = whole.num_rows - cut
        enough = max(enough, 2 * rows)  # a large group is looked at seldom while it grows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(parts: Iterator[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """PACKED of parts of ROWS, given as arrays: a row for each bucket that has some."""

    def made() -> pa.RecordBatch:
        rows = np.concatenate(held)
        bucket = ((rows["key"].view(np.uint64) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket)
        found, counts = np.unique(bucket, return_counts=True)
        ends = np.r_[0, np.cumsum(counts) * _ROW.itemsize].astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(rows[order])])
        return pa.RecordBatch.from_arrays([pa.array(found), blobs], names=["bucket", "rows"])

    held: list[np.ndarray] = []
    size = 0
    for part in parts:
        rows = np.empty(len(part[0]), _ROW)
        for name, column in zip(_ROW.names, part, strict=True):
            rows[name] = column.view(np.int64) if column.dtype == np.uint64 else column
        held.append(rows)
        size += len(rows)
        if size >= _PACK:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def _whole_buckets(batches: Iterator[pa.RecordBatch], enough: int = 100_000) -> Iterator[np.ndarray]:
    """The rows of whole buckets of sorted PACKED, in pieces of about ``enough`` rows."""
    held, rows, last = [], 0, None
    for batch in batches:
        blobs, bucket = batch["rows"], batch["bucket"].to_numpy()
        ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] // _ROW.itemsize
        whole = np.frombuffer(blobs.buffers()[2], np.uint8, int(ends[-1]) * _ROW.itemsize).view(_ROW)
        at = 0
        for cut in [*(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]:
            if bucket[at] != last and rows >= enough:
                yield np.concatenate(held)
                held, rows = [], 0
            held.append(whole[ends[at] : ends[cut]].copy())
            rows, last, at = rows + len(held[-1]), bucket[at], cut
    if held:
        yield np.concatenate(held)


def _near(n: np.ndarray, f: np.ndarray, g: np.ndarray, within: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(step, rows, bits) of one group's rows, sorted by size: row i and row i + step are of like size and differ in so many bits, ``within`` at most."""
    count = len(n)
    reach = np.searchsorted(n, (n + 1e-9) / least, "right") - np.arange(count) - 1
    low = high = 0
    for step in range(1, int(reach.max(initial=0)) + 1):
        if step % 64 == 1:  # rows outside have no partner so far ahead
            ahead = np.flatnonzero(reach >= step)
            low, high = int(ahead[0]), int(ahead[-1]) + 1
        end = min(high, count - step)
        apart = np.bitwise_count(f[low:end] ^ f[low + step : end + step])
        apart += np.bitwise_count(g[low:end] ^ g[low + step : end + step])
        at = np.flatnonzero(apart <= within)
        at = at[reach[low + at] >= step]
        if len(at):
            yield step, low + at, apart[at].astype(np.int64)


def _connecting(n: np.ndarray, f: np.ndarray, g: np.ndarray, within: int, least: float, start: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect one group's rows, sorted by size: forests at a third, two thirds and four fifths of the distance, and NEAREST rows of each.

    Farther pairs are left to ``straddling``, as most aren't similar; a row that has no others is paired with itself.
    """
    count = len(n)
    close = 4 * within // 5
    levels = [within // 3, 2 * within // 3, close]
    parents = [np.arange(count) for _ in levels]
    near = np.full((count, NEAREST), -1)
    gap = np.full((count, NEAREST), close + 1)
    met = np.zeros(count, bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for step, rows, apart in _near(n, f, g, within, least):
        ok = wanted[rows] | wanted[rows + step]
        met[rows[ok]] = met[rows[ok] + step] = True
        ok &= apart <= close
        i, j, d = rows[ok], rows[ok] + step, apart[ok]
        if not len(i):
            continue
        for level, parent in zip(levels, parents, strict=True):
            at = (d <= level) & (parent[i] != parent[j])
            if at.any():
                before = parent.copy()
                forest(parent, i[at], j[at])
                # of the pairs that join the same two sets one is enough
                key = np.minimum(before[i[at]], before[j[at]]) * count + np.maximum(before[i[at]], before[j[at]])
                one = np.unique(key, return_index=True)[1]
                out.append((i[at][one], j[at][one]))
        for a, b in ((i, j), (j, i)):
            worst = gap[a].argmax(axis=1)
            closer = d < gap[a, worst]
            gap[a[closer], worst[closer]] = d[closer]
            near[a[closer], worst[closer]] = b[closer]
    row, place = np.nonzero(near >= 0)
    out.append((row, near[row, place]))
    alone = np.flatnonzero(met & (near < 0).all(axis=1))
    out.append((alone, alone))
    left, right = (np.concatenate([o[k] for o in out]) for k in (0, 1))
    low, high = np.minimum(left, right), np.maximum(left, right)
    once = np.unique(low * count + high)
    return once // count + start, once % count + start


def within_bits(within: int, least: float) -> Pairing:
    """Pairs of rows of one key whose sizes allow the similarity ``least`` and whose 128-bit fingerprints differ in few bits.

    A first half of zero stands for no fingerprint: such rows pair by their sizes alone, all of them.
    """

    def pairs(key: np.ndarray, n: np.ndarray, fp: np.ndarray, fp2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.lexsort((n, key))
        k, n, f, g = key[order], n[order], fp[order], fp2[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(k)])
        end = np.repeat(starts + size, size)
        large = np.repeat(size > BIG, size) & (f != 0)
        at, step = np.flatnonzero(~large), 1
        while len(at):
            at = at[at + step < end[at]]
            at = at[n[at] >= least * n[at + step] - 1e-9]  # rows rise in size: later ones are too large as well
            ok = np.bitwise_count(f[at] ^ f[at + step]) + np.bitwise_count(g[at] ^ g[at + step]) <= within
            if ok.any():
                yield order[at[ok]], order[at[ok] + step]
            step += 1
        for a, z in zip(starts[size > BIG].tolist(), (starts + size)[size > BIG].tolist(), strict=True):
            if large[a:z].any():
                i, j = _connecting(n[a:z], f[a:z], g[a:z], within, least, a, large[a:z])
                yield order[i], order[j]

    return pairs


#: What a row of _paired's result is: a pair, a row of a group over ``hot``, a row of another group over BIG
_PAIR, _AGAIN, _LARGE = 0, 1, 2


def _paired(pairing: Pairing, hot: int | None, packs: bool = False):
    """(a, b) node pairs; of groups over ``hot`` or BIG also the rows themselves, as (node, key, n, fp, fp2), the former with their piece and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_buckets(batches) if packs else by_group(batches, ["key"]):
            key, node, n, fp, fp2 = (part[c] if packs else part[c].to_numpy() for c in _ROW.names)
            order = np.argsort(key)
            same = np.diff(key[order]) == 0
            order = order[np.r_[False, same] | np.r_[same, False]]  # most keys are of one row alone
            if not len(order):
                continue
            order = order[np.lexsort((node[order], key[order]))]
            k, m = key[order], node[order]
            order = order[np.r_[True, (k[1:] != k[:-1]) | (m[1:] != m[:-1])]]
            key, node, n, fp, fp2 = key[order], node[order], n[order], fp[order].view(np.uint64), fp2[order].view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.repeat(np.diff(np.r_[starts, len(key)]), np.diff(np.r_[starts, len(key)]))
            if hot is not None and (size > hot).any():
                over = np.flatnonzero(size > hot)
                pieces = -(-size[over] // max(1, hot // 2))
                # rows of like size lie together
                over, rank = over[np.lexsort((n[over], key[over]))], np.arange(len(over)) - np.searchsorted(key[over], key[over])
                yield _batch(node[over], key[over], n[over], fp[over], fp2[over], _AGAIN, rank * pieces // size[over], pieces)
                size[over] = 0
            if (large := (size > BIG) & (fp != 0)).any():
                yield _batch(node[large], key[large], n[large], fp[large], fp2[large], _LARGE)
            use = size > 1
            key, node, n, fp, fp2 = (x[use] for x in (key, node, n, fp, fp2))
            found = [np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]) for i, j in pairing(key, n, fp, fp2) if len(i)]
            if found:  # a pair that meets under several keys of a part goes out once
                a, b = np.concatenate(found, axis=1)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                none = np.zeros(int(once.sum()), np.uint64)
                yield _batch(a[once], b[once], none.astype(np.int32), none, none, _PAIR)

    return run


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray, fp: np.ndarray, fp2: np.ndarray, kind: int, piece: np.ndarray | int = 0, pieces: np.ndarray | int = 0) -> pa.RecordBatch:
    columns = [pa.array(a), pa.array(b), pa.array(n), pa.array(fp.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(np.full(len(a), kind, np.int8))]
    columns += [pa.array(np.broadcast_to(x, len(a)).astype(np.int32)) for x in (piece, pieces)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "fp", "fp2", "kind", "piece", "pieces"])


def _anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS of each row under a key for its own and every other piece of its group."""
    for batch in batches:
        node, key, n, fp, fp2, piece, pieces = (batch[c].to_numpy() for c in ("a", "b", "n", "fp", "fp2", "piece", "pieces"))
        for k in range(int(pieces.max(initial=1)) - 1):
            at = np.flatnonzero(k < pieces - 1)
            own, other = piece[at], k + (k >= piece[at])
            both = (np.minimum(own, other).astype(np.uint64) << np.uint64(32)) + np.maximum(own, other).astype(np.uint64)
            sub = mix64(mix64(both) ^ key[at].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sub, node[at], n[at], fp[at], fp2[at])], names=["key", "node", "n", "fp", "fp2"])


def _by_key(rows: DataFrame, by: str = "key") -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), by).sortWithinPartitions(by)


def dealt(rows: DataFrame, pairing: Pairing, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a <= b, of nodes of ROWS (or PACKED) that share a key and that ``pairing`` accepts, and the ROWS of groups over BIG.

    Of a group over BIG a row that has near rows, but none to be paired with here, comes as (a, a).
    """
    schema = "a long, b long, n int, fp long, fp2 long, kind tinyint, piece int, pieces int"
    packs = "bucket" in rows.columns
    found = stored(_by_key(rows, "bucket" if packs else "key").mapInArrow(_paired(pairing, hot, packs), schema))
    rest = found.filter(F.col("kind") == _AGAIN)
    if not rest.isEmpty():
        # a whole group comes from one task: its rows are spread before they are repeated
        spread = rest.repartition(partitions(rows.sparkSession))
        found = found.unionAll(stored(_by_key(spread.mapInArrow(_anew, ROWS)).mapInArrow(_paired(pairing, None), schema)))
    large = found.filter(F.col("kind") == _LARGE).select(F.col("b").alias("key"), F.col("a").alias("node"), "n", "fp", "fp2")
    return found.filter(F.col("kind") == _PAIR).select("a", "b").distinct(), large


def candidates(rows: DataFrame, pairing: Pairing, hot: int = HOT) -> DataFrame:
    """The pairs of ``dealt`` alone."""
    return dealt(rows, pairing, hot)[0].filter("a <> b")


def buckets(spark: SparkSession) -> int:
    """Among how many buckets keys are packed."""
    each, least = _BUCKETS
    return max(each * partitions(spark), least)


#: Classes of letters and of two neighbouring letters, by whose counts an edit distance is bounded
_RUNS = ((1, 128), (2, 512))
_AT_ONCE, _HELD = 1024, 1 << 25
#: Rows that are compared with all later ones of a group at once
_ROWS_AT_ONCE = 64
#: Rows of groups that are worked on together, pairs that one of them asks at once and at first
_ROWS_HELD, _ASKED, _FIRST = 8000, 8192, 512


def _profile(texts: list[str], runs_of: tuple[tuple[int, int], ...] = _RUNS) -> list[tuple[int, np.ndarray]]:
    """(size, how often runs of so many letters (code points) of each class occur in each text, 255 at most); the table held has a bounded size, of a large group the longest runs are left out."""
    sizes = [(size, classes) for size, classes in runs_of if size == 1 or len(texts) * classes <= _HELD]
    out = [(size, np.empty((len(texts), classes), np.uint8)) for size, classes in sizes]
    for low in range(0, len(texts), 64):
        some = texts[low : low + 64]
        length = np.fromiter(map(len, some), np.int64, len(some))
        code = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row, left = np.repeat(np.arange(len(some)), length), np.repeat(np.cumsum(length), length) - np.arange(len(code))
        for size, counts in out:
            classes, whole = counts.shape[1], np.flatnonzero(left >= size)  # runs that don't reach into the next text
            runs = code if size == 1 else mix64(sum(code[whole + k] << np.uint64(21 * k) for k in range(size)))
            place = row[whole] * classes + (runs % np.uint64(classes)).astype(np.int64)
            counts[low : low + 64] = np.minimum(np.bincount(place, minlength=len(some) * classes), 255).reshape(len(some), classes)
    return out


def _least_edits(counts: np.ndarray, i: np.ndarray, j: np.ndarray, touched: int) -> np.ndarray:
    """A lower bound of the edits between rows i and j: an edit takes away ``touched`` of the counted runs at most, and adds as many."""
    left, right = counts[i], counts[j]
    of_left, of_right, of_both = (x.sum(axis=1, dtype=np.int32) for x in (left, right, np.minimum(left, right)))
    return (np.maximum(of_left, of_right) - of_both) / touched


def _joined(n: np.ndarray, f: np.ndarray, g: np.ndarray, label: np.ndarray, texts: list[str], first: Callable[[int, int], bool], within: int, least: float, same: Callable[[str, str, float], bool], edits: bool = True) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of similar rows that join the components of one group, sorted by size.

    Each is tested unless its rows are joined already or this group isn't the ``first`` that they share.
    """
    found: list[tuple[int, int]] = []
    asked = _asked(n, f, g, label, texts, first, within, least, edits, found, 1)
    asks = next(asked, None)
    while asks is not None:
        try:
            asks = asked.send([same(texts[i], texts[j], least) for i, j in asks])
        except StopIteration:
            asks = None
        yield from found
        found.clear()


def _asked(n: np.ndarray, f: np.ndarray, g: np.ndarray, label: np.ndarray, texts: list[str], first: Callable[[int, int], bool], within: int, least: float, edits: bool, found: list[tuple[int, int]], at_once: int) -> Generator[list[tuple[int, int]], Sequence[bool], None]:
    """Gives lists of pairs to test, up to ``at_once`` each, is sent whether they are similar, and adds those that join to ``found``.

    The pairs and their order are those of one test at a time; of a list, pairs whose rows have been joined by then go.
    """
    parent = np.unique(label, return_inverse=True)[1]  # of each row; joining relabels
    profile = _profile(texts) if edits else []
    most = (1 - least) * np.fromiter(map(len, texts), np.int64, len(texts)) + 1e-9
    asks: list[tuple[int, int]] = []
    enough = min(_FIRST, at_once)

    def joins(answers: Sequence[bool]) -> int:
        """Takes the answers in; how many pairs to ask next: few while rows join, as others are joined by that."""
        before = len(found)
        for (i, j), good in zip(asks, answers, strict=True):
            if good and parent[i] != parent[j]:
                parent[parent == parent[j]] = parent[i]
                found.append((i, j))
        asks.clear()
        return min(64 if len(found) > before else 2 * enough, at_once)

    def apart() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that aren't joined, some steps' together."""
        left, right, held = [], [], 0
        for step, rows, _ in _near(n, f, g, within, least):
            at = rows[parent[rows] != parent[rows + step]]
            left.append(at)
            right.append(at + step)
            held += len(at)
            if held >= _AT_ONCE:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
        if held:
            yield np.concatenate(left), np.concatenate(right)

    for left, right in apart():
        for low in range(0, len(left), _AT_ONCE):
            i, j = left[low : low + _AT_ONCE], right[low : low + _AT_ONCE]
            for touched, counts in profile:
                near = _least_edits(counts, i, j, touched) <= np.maximum(most[i], most[j])
                i, j = i[near], j[near]
            for pair in zip(i.tolist(), j.tolist(), strict=True):
                if parent[pair[0]] != parent[pair[1]] and first(*pair):
                    asks.append(pair)
                    if len(asks) >= enough:
                        enough = joins((yield list(asks)))
    if asks:
        joins((yield list(asks)))


def _together(groups: list[tuple[Generator[list[tuple[int, int]], Sequence[bool], None], list[str]]], many: Many, least: float) -> None:
    """Runs `_asked` of several groups, with the pairs of all tested together."""
    open_ = [(asked, texts, asks) for asked, texts in groups if (asks := next(asked, None)) is not None]
    while open_:
        left, right = ([texts[p[side]] for _, texts, asks in open_ for p in asks] for side in (0, 1))
        answers, at, after = many(left, right, least), 0, []
        for asked, texts, asks in open_:
            mine = answers[at : at + len(asks)]
            at += len(asks)
            try:
                after.append((asked, texts, asked.send(mine)))
            except StopIteration:
                pass
        open_ = after


def straddling(rows: DataFrame, within: int, least: float, same: Callable[[str, str, float], bool], edits: bool = True, many: Many | None = None) -> DataFrame:
    """(a, b) of nodes in different components that are similar: no such pair of a group is left untested, save where others join its components.

    ``rows`` are those of groups over BIG with ``component``, ``text`` and ``keys``, a row's keys among these groups under
    the same fingerprint: a pair is tested under the smallest key that both have. With ``edits`` the similarity is by edits, so that counts of letters and of short runs of letters bound it. ``many`` is ``same`` of lists of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(batches, ["key"]):
            key, n, label, node = (part[c].to_numpy() for c in ("key", "n", "component", "node"))
            f, g = (part[c].to_numpy().view(np.uint64) for c in ("fp", "fp2"))
            order = np.lexsort((n, key))
            cuts = np.flatnonzero(np.diff(key[order])) + 1
            groups, links, rows_held = [], [], 0
            for own in np.split(order, cuts):
                if len(own) and (label[own] != label[own[0]]).any():
                    texts, keys = (part[c].take(pa.array(own)).to_pylist() for c in ("text", "keys"))
                    held, here = [set(k) for k in keys], int(key[own[0]])
                    first = lambda i, j, held=held, here=here: min(held[i] & held[j], default=here) == here
                    found: list[tuple[int, int]] = []
                    if many is None:
                        found += _joined(n[own], f[own], g[own], label[own], texts, first, within, least, same, edits)
                    else:
                        groups.append((_asked(n[own], f[own], g[own], label[own], texts, first, within, least, edits, found, _ASKED), texts))
                        rows_held += len(own)
                    links.append((own, found))
                if rows_held >= _ROWS_HELD:
                    _together(groups, many, least)
                    groups, rows_held = [], 0
            if many is not None:
                _together(groups, many, least)
            a, b = ([node[own[p[side]]] for own, found in links for p in found] for side in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _apart(within: int, least: float):
    """Of groups with rows of several components the rows that have a near row of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(batches, ["key"]):
            key, n, label = (part[c].to_numpy() for c in ("key", "n", "component"))
            f, g = (part[c].to_numpy().view(np.uint64) for c in ("fp", "fp2"))
            order, stay = np.lexsort((n, key)), np.zeros(len(key), bool)
            for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                if len(own) and (label[own] != label[own[0]]).any():
                    stay[own] = _with_others(n[own], f[own], g[own], label[own], within, least)
            yield from part.filter(pa.array(stay)).to_batches()

    return run


def _with_others(n: np.ndarray, f: np.ndarray, g: np.ndarray, label: np.ndarray, within: int, least: float) -> np.ndarray:
    """Which rows of one group, sorted by size, have a near row of another component."""
    count = len(n)
    last = np.searchsorted(n, (n + 1e-9) / least, "right")
    met, place = np.zeros(count, bool), np.arange(count)
    for low in range(0, count, _ROWS_AT_ONCE):
        rows, others = slice(low, min(low + _ROWS_AT_ONCE, count)), slice(low, int(last[min(low + _ROWS_AT_ONCE, count) - 1]))
        bits = np.bitwise_count(f[rows, None] ^ f[None, others])
        bits += np.bitwise_count(g[rows, None] ^ g[None, others])
        near = (bits <= within) & (label[rows, None] != label[None, others]) & (place[None, others] < last[rows, None])
        met[rows] |= near.any(axis=1)
        met[others] |= near.any(axis=0)
    return met


def across(large: DataFrame, named: DataFrame, text: DataFrame, within: int, least: float, same: Callable[[str, str, float], bool], edits: bool = True, many: Many | None = None) -> DataFrame:
    """``straddling`` of the ``large`` groups of ``dealt``, whose nodes are the h1 of ``named`` (h1, node, component); ``text`` has (node, text).

    A text goes only where its row has a near one of another component.
    """
    columns = ["key", "node", "n", "fp", "fp2", "component"]
    held = large.withColumnRenamed("node", "h1").join(named, "h1").select(*columns)
    opened = stored(_by_key(held).mapInArrow(_apart(within, least), held.schema))
    # by node alone, so that the texts meet them without another shuffle; a row has its line's keys under fingerprints of one kind
    keys = F.collect_list("key").over(Window.partitionBy("node", "fp", "fp2"))
    rows = opened.repartition(partitions(large.sparkSession), "node").withColumn("keys", keys).join(text.select("node", "text"), "node")
    return straddling(rows, within, least, same, edits, many)
