"""Periodic runs against brute force; grammar extensions against plain comparison."""

import hashlib
import random
import re
import zlib

import numpy as np

from nightjar.llm import periodic_runs
from nightjar.llm.periodic_runs import Grammar, find_runs, kept_words, runs_of
from nightjar.llm.queries import op11_periodic_runs
from tests.conftest import SF


def brute(words):
    """Every maximal stretch of each period, by stepping through the text; of one stretch the smallest period."""
    n, seen = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                seen.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in seen.items())


def made(rng, size, letters):
    out = []
    while len(out) < size:
        if rng.random() < 0.3:
            base = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
            out += (base * rng.randrange(1, 12))[: rng.randrange(1, 200)]
        elif rng.random() < 0.3 and out:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randrange(60)]
        else:
            out.append(rng.randrange(letters))
    return np.array(out, np.int64)


def test_extensions_are_exact():
    for seed in range(12):
        rng = random.Random(seed)
        inner = made(rng, rng.randrange(1, 1500), rng.choice([1, 2, 4, 100]))
        line = np.concatenate([[1000], inner, [1001]])
        grammar = Grammar(line, 4)
        a = np.array([rng.randrange(1, len(line) - 1) for _ in range(800)])
        b = np.array([rng.randrange(1, len(line) - 1) for _ in range(800)])
        a, b = a[a != b], b[a != b]
        ahead, back = grammar.ahead(a, b), grammar.back(a, b)
        for x, y, f, g in zip(a.tolist(), b.tolist(), ahead.tolist(), back.tolist(), strict=True):
            want = 0
            while max(x, y) + want < len(line) and line[x + want] == line[y + want]:
                want += 1
            assert f == want
            want = 0
            while min(x, y) - 1 - want >= 0 and line[x - 1 - want] == line[y - 1 - want]:
                want += 1
            assert g == want


def test_grammar_is_small():
    """Levels shrink by a constant share, and a block or a repeated stretch gets few names."""
    line = np.concatenate([[5], np.zeros(100_000, np.int64), [6], np.tile(np.arange(4), 25_000), [7]])
    grammar = Grammar(line, 8)
    assert len(grammar.levels) < 90 and sum(map(len, grammar.levels)) < 8 * len(line)


def test_runs_against_brute_force():
    for seed in range(40):
        rng = random.Random(seed)
        texts = [made(rng, rng.randrange(0, 500), rng.choice([1, 2, 3, 10, 1000])) for _ in range(12)]
        for text, got in zip(texts, runs_of(texts), strict=True):
            want = brute(text.tolist())
            assert [tuple(r) for r in got.tolist()] == want
            kept = np.ones(len(text), bool)
            for s, length, q in want:
                kept[s + q : s + length] = False
            assert (kept_words(len(text), got) == kept).all()


def test_least_lengths():
    """24 words and three periods are the bounds, at every place of the grid."""
    for q in (1, 2, 7, 8, 9, 11, 12, 20):
        for length in (max(24, 3 * q) - 1, max(24, 3 * q)):
            for before in range(0, 40, 3):
                word = [1000 + i for i in range(before)] + [i % q for i in range(length)] + [2000, 2001]
                got = [tuple(r) for r in runs_of([np.array(word)])[0].tolist()]
                assert got == ([(before, length, q)] if length >= max(24, 3 * q) else [])


def _digests(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    kept = [True] * n
    for s, length, q in runs:
        kept[s + q : s + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *row, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for w, k in zip(words, kept, strict=True) if k)))


def test_query_on_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = [r for r in docs if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert len(docs) > 150 and sum(got[r.doc_id][1] > 0 for r in docs) > 5
    for r in docs:
        assert got[r.doc_id] == _digests(r.doc_id, r.text)


def test_odd_rows(spark, monkeypatch):
    """Nulls, empty and white texts, repeated rows, odd white space, clashing columns, no rows, a long text, small groups."""
    monkeypatch.setattr(periodic_runs, "WORDS", 100)
    monkeypatch.setattr(periodic_runs, "ASKED", 7)
    rows = [("x", None, 1), (None, "", 2), ("y", " \t\n\x0b\x0c\r ", 3), ("z", "a\xa0b " * 30, 4), ("z", "a\xa0b " * 30, 4), ("w", "q " * 50_000 + "end", 5)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, runs int")
    got = sorted((r.doc_id or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(frame).collect())
    assert got == [("", 0, [], ""), ("w", 50_001, [(0, 50_000, 1)], "q end"), ("x", 0, [], ""), ("y", 0, [], ""), ("z", 30, [(0, 30, 1)], "a\xa0b"), ("z", 30, [(0, 30, 1)], "a\xa0b")]
    assert find_runs(frame.limit(0)).count() == 0
