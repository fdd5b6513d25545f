import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from nightjar.llm import bin_slack as bs

SCHEMA = "doc_id long, text string, piece string, length string, place string"


def test_fullest_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(200):
        left = sorted({rng.randrange(1, 30): rng.randrange(1, 3) for _ in range(5)}.items(), reverse=True)
        capacity = rng.randrange(0, 70)
        items = [x for x, n in left for _ in range(n)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= capacity)
        got = bs.fullest(capacity, left)
        assert sum(x * n for x, n in got.items()) == best
        assert all(n <= dict(left)[x] for x, n in got.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(8)
    for _ in range(20):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(30)}
        steps = bs.plan(histogram, 100)
        used = {}
        for combination, times in steps:
            assert sum(x * n for x, n in combination.items()) <= 100 and times > 0
            for x, n in combination.items():
                used[x] = used.get(x, 0) + n * times
        assert used == histogram


def test_word_cache_gives_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(bs.VOCABULARY)))
    encode = bs._token_bytes(str(public_tokenizers.path(bs.VOCABULARY)))
    texts = ["", " ", "Hello, world's end! it's 2024", "ÉCOLE école  nbsp x\x85y", "á ́ b", "ΣΑΣ ΟΔΟΣ. ς", "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|> A <|StartOfText|>B <|endoftext|>", "a <| B", "y" * 90 + " " + "Z" * 90, "İstanbul ﬁ ½ 日本語 한국어 🙂🙂", "tab\tnl\nvt\x0bff\x0ccr\rfs\x1cgs\x1d", "don'T we'LL'RE", "0" * 500, "H\u0331 h\u0331 A\u030a, \u212a K", "end. of, it., x!, 's. a.b, don't, e\u0301. É. É, \n., a,\nb.", "word,", "word. "]
    for t in texts + [" ".join(texts)]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [16, 4096])
def test_pack_is_whole_and_tight(spark, limit):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(bs.VOCABULARY)))
    rng = random.Random(6)
    rows = [(i, "word " * rng.randrange(0, 60), "p", "l", "x") for i in range(150)] + [(900, None, None, None, None), (901, "", "", "", ""), (902, "Very long text, " * 3000, "p", "l", "x"), (None, "no id", "p", "l", "x"), (3, "again", "", "", ""), (3, "again", "", "", "")]
    got = bs.pack(spark.createDataFrame(rows, SCHEMA), limit=limit).collect()
    want = []
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want.append((doc, n, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(w[3] for w in want)
    assert len(bins) <= -(-total // limit) * 1.05 + 1


def test_empty(spark):
    assert bs.pack(spark.createDataFrame([], SCHEMA)).count() == 0
