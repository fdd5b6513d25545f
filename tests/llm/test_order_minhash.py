import hashlib

from nightjar.llm import order_minhash as omh

SCHEMA = "doc_id long, text string, lang string, bucket string"


def brute_signature(text, slots, k):
    """The same choice by plain Python: two smallest of all numbered k-mers for each multiplier."""
    import numpy as np

    if not text:
        return [0] * slots
    k = min(k, len(text))
    grams = [text[i : i + k] for i in range(len(text) - k + 1)]
    one = {g: int(omh.mix64(omh._rolled(np.array([ord(c) for c in g], dtype=np.uint32), k))[0]) >> 24 for g in set(grams)}
    seen, keys = {}, []
    for g in grams:
        n = seen.get(g, 0)
        seen[g] = n + 1
        keys.append(int(omh.mix64(np.array([(one[g] + n * int(omh._PRIME)) % 2**64], dtype=np.uint64))[0]))
    out = []
    for m in omh._functions(slots, omh.SEED).tolist():
        order = sorted(range(len(keys)), key=lambda i: ((keys[i] >> 32) * m) % 2**32)[:2]
        a, b = min(order), max(order)
        x = int(omh.mix64(np.array([keys[a]], dtype=np.uint64))[0])
        out.append(int(omh.mix64(np.array([(x + keys[b] * int(omh._PRIME)) % 2**64], dtype=np.uint64))[0]) & 0xFFFF)
    return out


def test_signature_matches_brute_force():
    for text in ("a", "ab", "abcdefgh", "abcdefghi", "to be or not to be, that is the question. to be or not to be", "ñ日本語 " * 30):
        assert omh.signature(text, 16, 8).tolist() == brute_signature(text, 16, 8)


def test_order_matters_and_equal_texts_agree():
    a = "the first half of this text says one thing. " * 3
    b = "and the second half tells of another matter. " * 3
    s = omh.signature
    assert omh.likeness(s(a + b), s(a + b)) == 1.0
    assert omh.likeness(s(a + b), s(b + a)) < 1.0
    assert omh.likeness(s(""), s(None)) == 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for i, (doc, text, *_) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        sig, other, near = (omh.signature(x) for x in (text, new, following))
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), omh.to_text(sig), omh.to_text(other), omh.likeness(sig, other), omh.likeness(sig, near)))
    return out


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_query_against_brute_force(spark):
    rows = [(i * 3 % 41, f"row {i} " + "lorem ipsum é日 " * (i % 7), "en", "x") for i in range(41)]
    rows += [(100, None, None, None), (101, "", "en", ""), (102, "x" * 50_000, "en", None)]
    for n in (1, 2, 5, len(rows)):
        got = omh.neighbour_fingerprints(spark.createDataFrame(rows[:n], SCHEMA), buckets=7).collect()
        assert same([tuple(r) for r in got], brute(rows[:n]))


def test_ties_nulls_and_empty(spark):
    rows = [(5, "b", None, None), (5, "a", None, None), (5, "a", None, None), (None, "null id", None, None), (9, None, None, None)]
    got = omh.neighbour_fingerprints(spark.createDataFrame(rows, SCHEMA), buckets=3).collect()
    assert same([tuple(r) for r in got], brute(rows))
    assert omh.neighbour_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_at_the_ends_of_their_range(spark):
    ids = [2**63 - 1, 2**63 - 2, 2**63 - 600, 5, -(2**63) + 1, -(2**63), None]
    frame = spark.createDataFrame([(i, f"text number {n} of them") for n, i in enumerate(ids)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in omh.neighbour_fingerprints(frame).collect()) == sorted(i or 0 for i in ids)
