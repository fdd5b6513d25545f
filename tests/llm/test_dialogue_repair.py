"""Conversation repair against brute force over all cheapest edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from nightjar.llm import dialogue_repair
from nightjar.llm.dialogue_repair import END, Part, ranked_paths, repaired_conversations
from nightjar.llm.queries import op13_dialogue_repair
from tests.conftest import SF

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, least audit, repaired lines) of (initial-role, text, fault) rows, by a search over all edit strings that reads the grammar itself."""
    from heapq import heappop, heappush

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, "\n".join(lines)
        if (i, roles, audit) in done:
            continue
        done.add((i, roles, audit))
        steps = [(3, "I", i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((4, "D", i + 1, None, None))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                steps.append((more, "K", i + 1, role, f"{role}:{text}"))
                steps += [(3 + more, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for price, letter, to, role, line in steps:
            new = roles + (role[:1] or "?" if role is not None else "")
            if re.fullmatch(r"s?(ua)*u?", new):
                heappush(heap, (cost + price, audit + letter, to, new, lines + ((line,) if line is not None else ())))


def expected(conv, rows, damage=True):
    out = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub(r"[.!?]", "", text) if draw == 2 else text
        out += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in out:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:], strict=False))
    cost, audit, text = cheapest([(r, t, f) for (_, r, t), f in zip(out, faults, strict=True)])
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def drawn(rng, size):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", None, ""]])
    texts = ["Fine.", "Well!", "cut off", "So?", "", "  ", None, "a.\n", "b \t"]
    return [(rng.choice([i, i, i, i + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.randrange(99)}{rng.choice(['.', '!', ''])}") for i in range(size)]


def check(spark, conversations, damage=True):
    rows = [(c, t, r, x) for c, turns in conversations.items() for t, r, x in turns]
    random.Random(9).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in repaired_conversations(frame, damage).collect()}
    assert set(got) == {r[0] for r in rows}
    for c in got:
        assert got[c] == expected(c, [r[1:] for r in rows if r[0] == c], damage), (c, conversations[c])


def test_against_brute_force(spark):
    rng = random.Random(2)
    check(spark, {None if i == 5 else i: drawn(rng, rng.randrange(1, 8)) for i in range(120)})


def test_conversations_over_many_partitions(spark):
    """A few long conversations in 16 partitions, so that costs, states and neighbours pass over their boundaries."""
    rng = random.Random(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in range(2):
            rng = random.Random(seed)
            check(spark, {1: drawn(rng, 14), 2: drawn(rng, 3), 3: drawn(rng, 11)}, damage=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_parts_agree_with_the_whole():
    """Cutting a conversation anywhere, with the costs carried, gives the same path as the whole."""
    for seed in range(60):
        rng = random.Random(seed)
        classes = np.array([rng.randrange(12) for _ in range(rng.randrange(2, 60))])
        whole = ranked_paths(classes, [Part(0, len(classes), END, True)])
        _, nodes = whole.steps(np.array([0]))
        letters = whole.letter[nodes].tolist()
        cut = rng.randrange(1, len(classes))
        tail = ranked_paths(classes[cut:], [Part(0, len(classes) - cut, END, True)])
        carried = dialogue_repair.costs_before(classes[cut:].tolist(), END)[0]
        head = ranked_paths(classes[:cut], [Part(0, cut, carried, False)])
        _, first = head.steps(np.array([0]))
        _, second = tail.steps(head.exits(np.array([0])))
        assert head.letter[first].tolist() + tail.letter[second].tolist() == letters
        matrix = dialogue_repair._matrix(classes[:cut].tolist())
        assert [min(matrix[s][t] + carried[t] for t in range(4)) for s in range(4)] == dialogue_repair.costs_before(classes.tolist(), END)[0]


def test_path_is_the_least():
    """By plain recursion over all cheapest edit strings."""
    for seed in range(40):
        rng = random.Random(seed)
        classes = [rng.randrange(12) for _ in range(rng.randrange(0, 12))]
        costs = dialogue_repair.costs_before(classes, END)

        @lru_cache(None)
        def least(i, state):
            if i == len(classes) and costs[i][state] == 0:
                return ""
            found = []
            for letter in range(4):
                price = 3 if letter == 1 else dialogue_repair.COST[classes[i], state, letter] if i < len(classes) else 1 << 50
                to = int(dialogue_repair.NEXT[state]) if letter == 1 else int(dialogue_repair.TO[classes[i], state, letter]) if i < len(classes) else 0
                at = i if letter == 1 else i + 1
                if at <= len(classes) and price + costs[at][to] == costs[i][state]:
                    found.append("DIKR"[letter] + least(at, to))
            return min(found)

        paths = ranked_paths(np.array(classes, np.int64), [Part(0, len(classes), END, True)])
        _, nodes = paths.steps(np.array([0]))
        assert "".join("DIKR"[k] for k in paths.letter[nodes]) == least(0, 0)


def test_odd_rows(spark):
    """String ids, clashing columns, a conversation whose rows all go, a long text, no rows at all."""
    rows = [("x", 1, "user", "Hello " * 30_000 + ".", 1), ("x", 2, "assistant", "Yes.", 2), ("y", 1, "assistant", None, 3)]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, key int")
    got = {r.conv_id: (r.cost, r.audit) for r in repaired_conversations(frame, damage=False).collect()}
    assert got == {"x": (0, "KK"), "y": (4, "D")}
    assert repaired_conversations(frame.limit(0)).count() == 0


@pytest.mark.parametrize("columns", [("conv_id", "turn", "role", "text")])
def test_query_on_every_conversation(spark, columns):
    by = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").select(*columns).collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:] for r in op13_dialogue_repair(spark, SF).collect()}
    assert got == {c: expected(c, rows) for c, rows in by.items()}
