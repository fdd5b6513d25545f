import random

from pyspark.sql import functions as F

from nightjar.llm import _common as c


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (7, 3), (3, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent if any(x in l and l[0] != l[1] for l in links)}
    frame = spark.createDataFrame(links, "a long, b long")
    for bound in (0, 40, 10_000):
        assert {r.node: r.component for r in c.connected_components(frame, in_one_task=bound).collect()} == want
    assert c.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_global_row_number(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k long, v long")
    got = c.global_row_number(df, [F.col("k"), F.col("v")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(500))
    assert [(r.k, r.v) for r in got] == sorted((i % 7, i) for i in range(500))


def test_range_bucket(spark):
    df = spark.createDataFrame([(x,) for x in (-5, 0, 3, 4, 9, 10, 2**62, None)], "x long")
    for bounds in ([], [0], [0, 3, 4, 10], list(range(-3, 30, 3))):
        for r in df.select("x", c.range_bucket(F.col("x"), bounds).alias("b")).collect():
            assert r.b == (0 if r.x is None else sum(b <= r.x for b in bounds))
