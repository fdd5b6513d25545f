import zlib

import numpy as np

from nightjar.llm import feistel_shards as fs

SCHEMA = "doc_id long, text string, shard string, size string, row_number int"


def test_permutation_and_inverse():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        x = np.arange(n)
        p = fs.permute(x, n)
        assert sorted(p.tolist()) == x.tolist()
        assert fs.permute(p, n, back=True).tolist() == x.tolist()
    assert fs.permute(np.arange(1000), 1000, seed=1).tolist() != fs.permute(np.arange(1000), 1000, seed=2).tolist()


def test_shards_against_brute_force(spark):
    rows = [(i * 7 % 211, f"text {i} é" * (i % 5), "s", "z", i) for i in range(211)] + [(None, None, None, None, None), (3, "", "", "", 0), (3, "", "", "", 0)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    p = fs.permute(np.arange(len(rows)), len(rows)).tolist()
    want = sorted(((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode()), "rows", a % 40, a // 40, None) for r, a in zip(order, p, strict=True)), key=repr)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = fs.shards(frame).collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert sorted(map(tuple, fs.shards(frame.repartition(3)).collect()), key=repr) == want
    counts = np.bincount([r.shard for r in got], minlength=40)
    assert counts.max() - counts.min() <= 1
    assert fs.shards(spark.createDataFrame([], SCHEMA)).count() == 0
