import random

import numpy as np
import xxhash

from nightjar.llm import simhash_index as si

SCHEMA = "doc_id long, text string, fp string, component long"


def brute_fp(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, within=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= within:
                parent[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None and (r not in best or d < best[r]):
            best[r] = d
    return [best.get(find(i)) for i in range(len(ids))]


def test_simhash_matches_brute_force():
    for t in (None, "", " \t\n", "One", "one TWO", "Ünï CODE É x", "a b c", "a b c d a b c d a b c", "x y z\x0bq " * 40, "Σ is ς " * 9):
        assert si.simhash(t) == brute_fp(t)


def test_shingle_hash_is_xxh64_of_spark_too(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_index_finds_all_pairs():
    rng = random.Random(5)
    for within in (0, 1, 2, 3):
        base = [rng.getrandbits(64) for _ in range(12)]
        pats = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(30)})
        pats = [p % 2**64 for p in pats]
        groups = np.array([rng.randrange(3) for _ in pats])
        x = np.array(pats, dtype=np.uint64)
        order = np.lexsort((si.gray_rank(x), groups))
        x, groups = x[order], np.unique(groups[order], return_inverse=True)[1]
        index = si.GrayIndex(x, groups, fanout=3)
        got = {(int(a), int(b)) for q, e in index.search(x, groups, within, block=50) for a, b in zip(q, e, strict=True)}
        want = {(i, j) for i in range(len(x)) for j in range(len(x)) if groups[i] == groups[j] and bin(int(x[i]) ^ int(x[j])).count("1") <= within}
        assert got == want


def test_gray_rank_is_the_inverse_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (si.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def rows_of_texts(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(12):
            new = list(base)
            for _ in range(rng.randrange(3)):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(" ".join(new))
    texts += ["", None, "  ", "single", "Single", texts[0], texts[0].upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "clash", 1) for i, t in zip(ids, texts, strict=True)]
    rows += [(None, "", "x", None), (None, "only here and without an id", None, None), (rows[0][0], rows[0][1], None, None)]
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(((r[0], format(f, "016x"), c) for r, f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps), strict=True)), key=repr)
    got = sorted(map(tuple, si.near_duplicates(rows_of_texts(spark, rows)).collect()), key=repr)
    assert got == want
    kept = sorted(((r.doc_id is None, r.doc_id or 0) for r in si.keep_one(rows_of_texts(spark, rows)).collect()))
    groups = {(w[2], None if w[2] is not None else w[1]) for w in want}
    assert kept == sorted((g is None, g or 0) for g, _ in groups)


def test_a_null_id_linked_to_an_id_goes_and_large_ids_are_named(spark):
    far = 2**63 - 1
    rows = [(far, "one text in two rows", "", 0), (None, "one text in two rows", "", 0), (None, "without any id", "", 0), (None, "without any id", "", 0), (far - 1, "another with a large id", "", 0)]
    frame = rows_of_texts(spark, rows)
    assert sorted((r.doc_id for r in si.keep_one(frame).collect()), key=repr) == sorted([far, None, far - 1], key=repr)
    assert {(r.doc_id, r.component_id) for r in si.near_duplicates(frame).collect()} == {(far, far), (None, far), (None, None), (far - 1, far - 1)}


def test_an_id_with_two_texts_joins_nothing(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    frame = rows_of_texts(spark, [(5, a, "", 0), (5, b, "", 0), (3, a, "", 0), (4, b, "", 0)])
    assert sorted((r.doc_id, r.component_id) for r in si.near_duplicates(frame).collect()) == [(3, 3), (4, 4), (5, 3), (5, 4)]
    assert sorted(r.doc_id for r in si.keep_one(frame).collect()) == [3, 4]


def test_hot_groups_and_empty(spark):
    rows = [(i, "copy of one text that repeats", None, None) for i in range(600)] + [(600 + i, None, None, None) for i in range(5)]
    got = si.near_duplicates(rows_of_texts(spark, rows)).collect()
    assert {(r.doc_id < 600, r.component_id) for r in got} == {(True, 0), (False, 600)}
    assert si.near_duplicates(rows_of_texts(spark, [])).count() == 0
