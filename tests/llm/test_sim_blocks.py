import random

import numpy as np

from nightjar.llm import sim_blocks as sb

INSIDE = np.array([chr(c).isalnum() or c > 127 for c in range(256)])


def test_word_hashes_are_those_of_the_words_at_any_piece():
    text = b"one two  three, two " + b"x" * 500 + b" one"
    words = [b"one", b"two", b"three", b"two", b"x" * 500, b"one"]
    alone = [int(sb.word_hashes(w, INSIDE)[0][0]) for w in words]
    for piece in (7, 16, 100, 1 << 20):
        hashes, at = sb.word_hashes(text, INSIDE, piece)
        assert hashes.tolist() == alone
        assert [text[i : i + 3] for i in at.tolist()] == [w[:3] for w in words]
    assert len(sb.word_hashes(b"", INSIDE)[0]) == 0 and len(sb.word_hashes(b" , ", INSIDE)[0]) == 0
    assert len(set(alone)) == 4


def test_votes_against_counting():
    rng = random.Random(1)
    for counts in ([1, 2, 3], [700, 1, 5, 256, 255], [4] * 9000):
        h = [rng.getrandbits(64) for _ in range(sum(counts))]
        want, at = [], 0
        for n in counts:
            want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h[at : at + n]) > n))
            at += n
        assert sb.votes(np.array(h, dtype=np.uint64), np.array(counts)).tolist() == want


def test_shingles_and_neighbours():
    h = np.arange(10, dtype=np.uint64)
    assert len(sb.shingled(h, 5)) == 6 and len(sb.shingled(h[:3], 5)) == 1 and len(sb.shingled(h[:0], 5)) == 0
    two = sb.with_previous(np.array([1, 2, 1, 2], dtype=np.uint64), np.array([2, 0, 2]))
    assert two[0] == two[2] and two[1] == two[3] and two[0] != two[1]


def test_untouched_classes_keep_their_keys():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(8, 60)
        a = [rng.getrandbits(64) for _ in range(n)]
        b = list(a)
        b[rng.randrange(n)] = rng.getrandbits(64)
        key, run = sb.block_keys(np.array(a + b, dtype=np.uint64), np.array([n, n]), 3.0, 16)
        assert set(key[run == 0].tolist()) & set(key[run == 1].tolist())
