"""Conversation structure repair: cost DP, then prefix-doubling path ranking.

The rows of a conversation, in turn order, are edited until their role initials read (s?(ua)+)?. The states of a reader of
that pattern at the places between rows are nodes; keeping, re-roling or deleting a row and inserting one are arcs. A
row's arcs are a small min-plus matrix, so the cost to the end of the conversation is found partition by partition,
with one product carried over each partition boundary. Arcs on cheapest paths form a DAG whose nodes are then ranked by the
first 1, 2, 4, ... letters of the least audit that starts there: the rank of a doubled length comes from the node's own rank and that
of the node which its pointer of the single length leads to. The ranks choose each node's arc, and the doubled pointers spell the whole path.

Rows are numbered globally and dealt by range, so that a conversation of any length lies over many tasks; only costs and
states at the partitions' boundaries (a row a partition) pass through the driver. Texts aren't part of that: they are
joined to their edits by row number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.llm._common import global_row_number, partitions, pinned

#: Costs of edits, and of each truncated row that stays
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters of edits in ASCII order, as the ranks need them: delete, insert, keep, rerole
LETTERS = "DIKR"
FAR = 1 << 40
#: States of the reader: nothing yet, after a system row, after a user row, after an assistant row
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Next state by an inserted or re-roled row
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Initials: s, u, a, any other; of two neighbours these are legal
INITIALS, LEGAL = "sua", {(0, 1), (1, 2), (2, 1)}
WHITE = r"\x20\x09-\x0D"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(cost, next state) by class of row (3 * initial + 0 sound, 1 to be deleted, 2 truncated), state and letter."""
    cost, to = np.full((12, 4, 4), FAR), np.zeros((12, 4, 4), np.int64)
    reads = {(EMPTY, 0): SYSTEM, (EMPTY, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
    for kind in range(4):
        for fault in range(3):
            c, more = 3 * kind + fault, TRUNCATED if fault == 2 else 0
            for state in range(4):
                cost[c, state, 0], to[c, state, 0] = DELETE, state
                to[c, state, 1] = NEXT[state]  # an insertion stays before the row; it is priced apart
                if fault != 1:
                    cost[c, state, 3], to[c, state, 3] = REROLE + more, NEXT[state]
                    if (state, kind) in reads:
                        cost[c, state, 2], to[c, state, 2] = more, reads[state, kind]
    return cost, to


COST, TO = _tables()


def _with_inserts(base: list[int]) -> list[int]:
    """Cheapest costs from the four states where rows may be inserted first."""
    user = min(base[USER], base[ASSISTANT] + INSERT)
    return [min(base[EMPTY], user + INSERT), min(base[SYSTEM], user + INSERT), user, min(base[ASSISTANT], base[USER] + INSERT)]


END = _with_inserts([0, FAR, FAR, 0])
_STEPS = [[[(int(COST[c, s, e]), int(TO[c, s, e])) for e in (0, 2, 3) if COST[c, s, e] < FAR] for s in range(4)] for c in range(12)]


def costs_before(classes: list[int], end: list[int]) -> list[list[int]]:
    """From each state before each row, and last at the end: the cheapest cost to the conversation's end."""
    out = [end]
    for c in reversed(classes):
        after = out[-1]
        out.append(_with_inserts([min(cost + after[to] for cost, to in arcs) for arcs in _STEPS[c]]))
    return out[::-1]


class Part(NamedTuple):
    """The rows of one conversation in one partition: [begin, end), costs where they end, and whether the conversation ends there."""

    begin: int
    end: int
    costs: list[int]
    last: bool


@dataclass
class Paths:
    """Optimal arcs of the parts of a partition, ranked; node 4 * layer + state, a part having a layer a row and one more."""

    parts: list[Part]
    letter: np.ndarray
    layer_row: np.ndarray
    jumps: list[np.ndarray]

    def entry(self, part: int, state: int) -> int:
        return 4 * (self.parts[part].begin + part) + state

    def exits(self, nodes: np.ndarray) -> np.ndarray:
        """The states in which the paths from these nodes leave their part."""
        for jump in self.jumps:
            nodes = jump[nodes]
        return nodes % 4

    def steps(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, node) of every node with an edit on the paths from these nodes, path by path, spelt by doubled pointers."""
        at, length = nodes.copy(), (self.letter[nodes] >= 0).astype(np.int64)
        for k in reversed(range(len(self.jumps))):
            beyond = self.jumps[k][at]
            more = self.letter[beyond] >= 0
            at = np.where(more, beyond, at)
            length += more.astype(np.int64) << k
        start = np.repeat(np.arange(len(nodes)), length)
        step = np.arange(len(start)) - np.repeat(np.cumsum(length) - length, length)
        at = nodes[start]
        for k, jump in enumerate(self.jumps):
            at = np.where(step >> k & 1, jump[at], at)
        return start, at


def ranked_paths(classes: np.ndarray, parts: list[Part]) -> Paths:
    """The least of the cheapest paths from every node, by prefix doubling."""
    known = [costs_before(classes[p.begin : p.end].tolist(), p.costs) for p in parts]
    left = np.array([c for costs in known for c in costs], np.int64).reshape(-1, 4)
    layers = len(left)
    row = np.full(layers, -1)
    closing = np.array([p.end + i for i, p in enumerate(parts)], np.int64)
    is_row = np.ones(layers, bool)
    is_row[closing] = False
    row[is_row] = np.concatenate([np.arange(p.begin, p.end) for p in parts])
    # arcs by letter: where they lead and whether they are on a cheapest path
    target = np.zeros((layers, 4, 4), np.int64)
    price = np.full((layers, 4, 4), FAR)
    at = np.flatnonzero(is_row)
    target[at] = 4 * (at + 1)[:, None, None] + TO[classes[row[at]]]
    price[at] = COST[classes[row[at]]]
    inserts = is_row.copy()
    inserts[closing] = [p.last for p in parts]  # else the same place is the next part's first layer
    target[:, :, 1] = 4 * np.arange(layers)[:, None] + NEXT
    price[inserts, :, 1] = INSERT
    optimal = (price + left.reshape(-1)[target] == left[:, :, None]).reshape(-1, 4)
    target = target.reshape(-1, 4)
    nodes = np.arange(4 * layers)
    going = optimal.any(1)
    letter = np.where(going, optimal.argmax(1), -1)  # an edit and a state give one next state: letters of a node's arcs differ
    jump = np.where(going, target[nodes, np.maximum(letter, 0)], nodes)
    rank, ahead = letter + 1, jump
    while going[ahead].any():
        _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)
        ahead = ahead[ahead]
    # an arc of the least letter, and of those the one to the least rest
    best = np.where(optimal, np.arange(4) * (int(rank.max(initial=0)) + 1) + rank[target], FAR).argmin(1)
    letter = np.where(going, best, -1)
    jumps = [np.where(going, target[nodes, best], nodes)]
    while going[jumps[-1]].any():
        jumps.append(jumps[-1][jumps[-1]])
    return Paths(parts, letter, row, jumps)


def _matrix(classes: list[int]) -> list[list[int]]:
    """Cheapest costs from each state before the rows to each state after the last one, insertions before rows included."""
    columns = [costs_before(classes, [0 if s == to else FAR for s in range(4)])[0] for to in range(4)]
    return [[columns[to][s] for to in range(4)] for s in range(4)]


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, list[int]]:
    """A partition's rows and where its conversations begin, with the end of the last."""
    held = list(batches)
    table = pa.Table.from_batches(held).combine_chunks() if held else _SLIM.empty_table()
    keys = table["key"].to_pylist()
    return table, [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]


_SLIM = pa.schema([("at", pa.int64()), ("key", pa.string()), ("cls", pa.int64())])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, cuts = _partition(batches)
    if table.num_rows:
        cls = table["cls"].to_pylist()
        yield pa.RecordBatch.from_pylist([{
            "part": TaskContext.get().partitionId(), "single": len(cuts) == 2, "first": table["key"][0].as_py(), "last": table["key"][-1].as_py(),
            "last_cls": cls[-1], "costs": sum(_matrix(cls[: cuts[1]]), []),
        }], pa.schema([("part", pa.int32()), ("single", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("last_cls", pa.int64()), ("costs", pa.list_(pa.int64()))]))


class Bounds(NamedTuple):
    """What a partition has to know of its neighbours."""

    end: list[int]
    ends: bool
    before: int
    state: int


def _parts(cuts: list[int], known: Bounds) -> list[Part]:
    last = len(cuts) - 2
    return [Part(cuts[i], cuts[i + 1], known.end if i == last else END, known.ends if i == last else True) for i in range(last + 1)]


def _edits(slim: DataFrame) -> DataFrame:
    """slim (at, key, cls) with part, before, act, role, after, cost, illegal, chunk for each row.

    before and after have initials of inserted rows, act the edit's letter, role the new role of a re-roled row, chunk (in a
    part's first row) the part's letters.
    """
    dealt = pinned(slim.repartitionByRange(partitions(slim.sparkSession), "at").sortWithinPartitions("at"))
    pieces = sorted(dealt.mapInArrow(_summary, "part int, single boolean, first string, last string, last_cls long, costs array<long>").collect(), key=lambda r: r.part)
    bounds: dict[int, Bounds] = {}
    for i in reversed(range(len(pieces))):
        here, after = pieces[i], pieces[i + 1] if i + 1 < len(pieces) else None
        end, ends = END, True
        if after and after.first == here.last:
            rest = bounds[after.part].end if after.single else END
            end, ends = [min(after.costs[4 * s + t] + rest[t] for t in range(4)) for s in range(4)], False
        before = pieces[i - 1].last_cls // 3 if i and pieces[i - 1].last == here.first else -1
        bounds[here.part] = Bounds(end, ends, before, EMPTY)

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cuts = _partition(batches)
        if table.num_rows:
            part = TaskContext.get().partitionId()
            last = _parts(cuts, bounds[part])[-1]
            paths = ranked_paths(table["cls"].to_numpy()[last.begin :], [Part(0, last.end - last.begin, last.costs, last.last)])
            yield pa.RecordBatch.from_pylist([{"part": part, "states": paths.exits(np.arange(4)).tolist()}], pa.schema([("part", pa.int32()), ("states", pa.list_(pa.int64()))]))

    left = {r.part: r.states for r in dealt.mapInArrow(leaving, "part int, states array<long>").collect()} if any(not b.ends for b in bounds.values()) else {}
    for here, after in zip(pieces, pieces[1:], strict=False):
        if not bounds[here.part].ends:
            entered = bounds[here.part].state if here.single else EMPTY
            bounds[after.part] = bounds[after.part]._replace(state=left[here.part][entered])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cuts = _partition(batches)
        rows = table.num_rows
        if not rows:
            return
        part = TaskContext.get().partitionId()
        known, cls = bounds[part], table["cls"].to_numpy()
        parts = _parts(cuts, known)
        paths = ranked_paths(cls, parts)
        start, nodes = paths.steps(np.array([paths.entry(i, EMPTY if i else known.state) for i in range(len(parts))]))
        letter, layer = paths.letter[nodes], nodes // 4
        row = paths.layer_row[layer]
        entered = paths.jumps[0][nodes] % 4
        acts = letter != 1
        act, role, cost = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        act[row[acts]], role[row[acts]] = letter[acts], entered[acts]
        cost[row[acts]] = COST[cls[row[acts]], nodes[acts] % 4, letter[acts]]
        before, after = [""] * rows, [""] * rows
        for i in np.flatnonzero(~acts).tolist():
            at, initial = int(row[i]), "a" if entered[i] == ASSISTANT else "u"
            if at >= 0:
                before[at] += initial
            else:  # at the conversation's end
                at = parts[start[i]].end - 1
                after[at] += initial
            cost[at] += INSERT
        kind = cls // 3
        illegal = np.zeros(rows, bool)
        pair = list(zip(kind[:-1].tolist(), kind[1:].tolist(), strict=True))
        illegal[1:] = [p not in LEGAL for p in pair]
        illegal[cuts[:-1]] = False
        illegal[0] = known.before >= 0 and (known.before, int(kind[0])) not in LEGAL
        spelt = np.frombuffer(LETTERS.encode(), np.uint8)[letter].tobytes().decode()
        chunk, upto = [None] * rows, np.searchsorted(start, np.arange(len(parts) + 1)).tolist()
        for i, p in enumerate(parts):
            chunk[p.begin] = spelt[upto[i] : upto[i + 1]]
        names = np.array(["", "", "user", "assistant"], object)
        more = [pa.array(np.full(rows, part, np.int32)), pa.array(before, pa.string()), pa.array([LETTERS[a] for a in act], pa.string()), pa.array(np.where(act == 3, names[role], None).tolist(), pa.string()), pa.array(after, pa.string()), pa.array(cost), pa.array(illegal), pa.array(chunk, pa.string())]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns] + more, names=table.column_names + ["part", "before", "act", "role", "after", "cost", "illegal", "chunk"])

    return pinned(dealt.mapInArrow(spell, "at long, key string, cls long, part int, before string, act string, role string, after string, cost long, illegal boolean, chunk string"))


class Repair(NamedTuple):
    """report: a row a conversation. rows: conv_id, key, at, sub, edit, role, text of what is left, in (at, sub) order within a conversation."""

    report: DataFrame
    rows: DataFrame


def _key(conv: str) -> Column:
    """An id of any type, or its absence, as a string."""
    return F.to_json(F.struct(F.col(conv).alias("id")))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Faults, cheapest edits and repaired rows of conversations.

    report: conv_id, key, gaps, blank, duplicate, truncated, illegal, cost (longs), audit. A null role or text is one space, so such
    a text is blank; rows of a null conversation id are one conversation; null turns come first. Rows of one turn are in the order of
    role and MD5 of text; equal rows are duplicates but for the first. Conversations without rows are not in the result. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("seen"),
    ).withColumn("digest", F.md5("text")).withColumn("key", _key("conv_id"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("seen")]
    numbered = global_row_number(rows, order, "at").drop("seen")
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    cut = F.col("text").rlike(rf"[^{WHITE}.!?][{WHITE}]*\z")
    first = numbered.groupBy("key", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    kind = F.coalesce(*[F.when(F.substring("role", 1, 1) == initial, i) for i, initial in enumerate(INITIALS)], F.lit(3))
    slim = numbered.select("at", "key", "conv_id", "turn", kind.alias("kind"), blank.alias("blank"), cut.alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    faults = pinned(slim.join(first, "at", "left").select("at", "key", "conv_id", "turn", "kind", fault.alias("fault")))
    code = F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 2).otherwise(1)
    edits = _edits(faults.select("at", "key", (F.col("kind") * 3 + code).cast("long").alias("cls")))

    counted = [F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    seen = faults.groupBy("key").agg(F.first("conv_id").alias("conv_id"), gaps.alias("gaps"), *counted)
    pieces = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("part", "chunk"))))
    spelt = edits.groupBy("key").agg(F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(pieces, lambda p: p["chunk"]), "").alias("audit"))
    report = seen.join(spelt, "key").select("conv_id", "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    inserted = lambda initials: F.transform(
        F.filter(F.split(initials, ""), lambda c: c != ""), lambda c: F.struct(F.lit("I").alias("edit"), F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))
    )
    both = numbered.select("at", "conv_id", "key", F.col("role").alias("had"), "text").join(edits.select("at", "before", "act", "role", "after"), "at")
    own = F.array(F.struct(F.col("act").alias("edit"), F.coalesce("role", "had").alias("role"), F.col("text")))
    kept = F.when(F.col("act") == "D", F.slice(own, 1, 0)).otherwise(own)
    left = both.select("conv_id", "key", "at", F.posexplode(F.concat(inserted("before"), kept, inserted("after"))).alias("sub", "row")).select("conv_id", "key", "at", "sub", "row.*")
    return Repair(report, left)


def text_digests(rows: DataFrame) -> DataFrame:
    """key, repaired_sha256 of the `role:text` lines of each conversation, joined by newlines.

    A digest of a conversation is one sequential computation: its rows stream through one task, which holds a batch of them at a time.
    """
    line = F.concat("role", F.lit(":"), "text")
    dealt = rows.select("key", "at", "sub", line.alias("line")).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "at", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, done = None, None, []
        for batch in batches:
            for key, line in zip(batch["key"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if key == last:
                    digest.update(b"\n")
                else:
                    if digest:
                        done.append((last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256()
                digest.update(line.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["key", "repaired_sha256"])
                done = []
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])

    kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return dealt.mapInArrow(run, kind)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults by crc32(`conv_id:turn`) % 20: 0 is dropped, 1 loses its text, 2 its `[.!?]`, 3 comes twice, 4 is a user's. Nulls are one space."""
    name = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("draw"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    hit = rows.filter("draw <> 0").select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "draw")
    return hit.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("draw") == 3, 2).otherwise(1)))).drop("draw", "copy")


def repaired_conversations(turns: DataFrame, damage: bool = True) -> DataFrame:
    """Every conversation id of ``turns`` with its report and digest after (damage and) repair; without rows: zeros, empty audit, digest of the empty string."""
    done = repair(damaged(turns) if damage else turns)
    all_ids = turns.select("conv_id").distinct().withColumn("key", _key("conv_id"))
    whole = all_ids.join(done.report.drop("conv_id"), "key", "left").join(text_digests(done.rows), "key", "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
