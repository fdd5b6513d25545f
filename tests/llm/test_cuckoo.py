import hashlib
import random
import re

from nightjar.llm import cuckoo

SCHEMA = "doc_id long, text string, digest string, n long"


def test_index_inserts_deletes_and_resizes():
    rng = random.Random(1)
    index, held = cuckoo.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for _ in range(30_000):
        k = rng.choice(keys)
        if rng.random() < 0.35:
            assert index.delete(k) == held.pop(k, None)
        else:
            held[k] = rng.random()
            index.insert(k, held[k])
    assert dict(index.items()) == held and len(index) == len(held)
    assert index.mask + 1 > 2
    for k in keys:
        assert index.get(k) == held.get(k)
    assert sum(map(len, index.tags)) == len(held)


def test_colliding_tags_are_told_apart_by_content():
    index = cuckoo.CuckooIndex(2)
    keys = [bytes(8) + bytes([i]) for i in range(60)]  # one bucket, one tag
    for i, k in enumerate(keys[:7]):
        index.insert(k, i)
    assert [index.get(k) for k in keys[:7]] == list(range(7)) and index.get(keys[9]) is None
    assert index.delete(keys[3]) == 3 and index.get(keys[3]) is None and index.get(keys[4]) == 4


def brute(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, len(text or "")))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(d, best[0], len(members), (d, n) == best, hashlib.sha256(norm.encode()).hexdigest()) for d, n in members]
    return sorted(out, key=repr)


def test_groups_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["a b", "ab", "a b", " a\tb\n", "é x", None, "", " ", "long " * 9000, "long" * 9000]
    rows = [(i if i % 17 else None, rng.choice(texts), "x", i) for i in range(300)] + [(1, "a b", None, None), (1, "a b", None, None)]
    for live in (2, 3, 1000):
        got = cuckoo.exact_groups(spark.createDataFrame(rows, SCHEMA), live=live).collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert cuckoo.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_without_copies_keeps_one(spark):
    rows = [(1, "a b", "x", 1), (2, "ab", "y", 2), (3, "c", "z", 3)]
    assert sorted(r.doc_id for r in cuckoo.without_copies(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 3]


def test_without_copies_tells_texts_of_one_id_apart(spark):
    rows = [(1, "a b", "", 0), (2, "a  b", "", 0), (1, "unique", "", 0), (None, "null", "", 0), (None, "null", "", 0), (None, None, "", 0), (5, "", "", 0), (6, "same", "", 0), (6, "same", "", 0)]
    got = cuckoo.without_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(2, "a  b"), (1, "unique"), (None, "null"), (5, ""), (6, "same")], key=repr)
