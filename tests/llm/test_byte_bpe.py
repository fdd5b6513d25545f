"""Byte-level BPE against the tiktoken library and against the sequential definition."""

import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from nightjar.llm import byte_bpe
from nightjar.llm.byte_bpe import Coder, Merger, RankBitmap
from nightjar.llm.queries import op12_byte_bpe
from tests.conftest import SF

PATH = public_tokenizers.path(byte_bpe.RANKS)
ALPHABET = ["a", "b", "é", " ", "  ", "\n", "\n\n", "the", " the", "1", "'s", "'ll", "😀", "\x85", "　", "!", "?!", "\t", "\0", ",", ".", "ß"]


@pytest.fixture(scope="module")
def coder():
    return Coder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.merger.ranks, special_tokens={})


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_bitmap_gives_the_smallest():
    rng, bits, plain = random.Random(3), RankBitmap(1 << 16), set()
    for _ in range(20_000):
        rank = rng.randrange(1 << 16) if rng.random() < 0.5 or not plain else min(plain)
        (bits.discard if rank in plain else bits.add)(rank)
        plain ^= {rank}
        assert bits.first() == min(plain, default=-1)


def test_against_the_library(coder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(120))) for _ in range(2000)] + ["", "<|endoftext|>", "a" * 5001, "ab" * 4000 + "c"]
    assert [unpacked(i) for i in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    of = byte_bpe.tokens(PATH)
    assert [byte_bpe.text_bytes(i, of).decode() for i in coder.encode(texts)] == texts


def test_code_points_in_context(coder, library):
    texts = [f"a {c}b 1{c} {c}.{c}{c}" for c in map(chr, [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F700)])]
    assert [unpacked(i) for i in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def _sequential(ranks, piece):
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_ranks_in_any_order():
    """Rank files in which a merge brings up a smaller rank: the next pair is always the least, leftmost one."""
    for seed in range(60):
        rng = random.Random(seed)
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 256 + 25:
            tokens.add(b"".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(2, 5))))
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {token: rank for rank, token in enumerate(order)}
        pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))).encode() for _ in range(80)] + [b"a" * 37]
        assert [unpacked(i) for i in Merger(ranks).encode(pieces)] == [_sequential(ranks, p) for p in pieces]


def test_cache_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 10)
    monkeypatch.setattr(byte_bpe, "LONGEST", 4)
    small, rng = Coder(PATH, public_tokenizers.PATTERN), random.Random(5)
    for _ in range(20):
        texts = ["".join(rng.choice([*ALPHABET, "longerword", " anotherword."]) for _ in range(30)) for _ in range(10)]
        assert [unpacked(i) for i in small.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_other_patterns(library):
    ranks = library._mergeable_ranks
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    texts = ["Of course, the\nlonger way  round.", " x"]
    assert [unpacked(i) for i in Coder(PATH, r"\S+|\s+").encode(texts)] == [own.encode_ordinary(t) for t in texts]


def test_odd_rows(spark, library):
    """Nulls, empty and repeated rows, ids of another type, clashing columns, no rows, a very long text."""
    rows = [("x", None, 1), ("x", None, 1), (None, "a b", 2), ("y", "", 3), ("z", "word, " * 40_000, 4)]
    frame = spark.createDataFrame(rows, "doc_id string, text string, ids int").withColumnRenamed("ids", "n_tokens")
    got = byte_bpe.decode(byte_bpe.encode(frame)).collect()
    assert sorted((r.doc_id or "", r.n_tokens, bytes(r.decoded)) for r in got) == sorted((d or "", len(library.encode_ordinary(t or "")), (t or "").encode()) for d, t, _ in rows)
    assert byte_bpe.decode(byte_bpe.encode(frame.limit(0))).count() == 0


def test_query_on_every_document(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in op12_byte_bpe(spark, SF).collect()} == want


def test_rank_file_is_a_parameter(spark, tmp_path):
    lines = [base64.b64encode(bytes([b])) + b" %d" % b for b in range(256)] + [base64.b64encode(b"ab") + b" 256", b""]
    (tmp_path / "own.tiktoken").write_bytes(b"\n".join(lines))
    got = byte_bpe.encode(spark.createDataFrame([(1, "abab b")], "doc_id long, text string"), ranks=str(tmp_path / "own.tiktoken")).collect()
    assert unpacked(bytes(got[0].ids)) == [256, 256, 32, 98]
