import random

from pyspark.sql import functions as F

from nightjar.llm import pareto_mix as pm

SCHEMA = "doc_id long, text string, source string, size string, target string"


def waterfill(sizes):
    """Targets by resharing, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= 3 * sizes[s]] if free else []
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.remove(s)
            left -= out[s]


def sample(n=1500):
    rng = random.Random(9)
    sources = ["big"] * 20 + ["a", "b", "é", "Z", None]
    rows = [(i, "w " * rng.choice([0, 3, 20, 200]), rng.choice(sources), "x", "y") for i in range(n)]
    return rows + [(None, None, None, None, None), (7, "", "a", "", ""), (5, "w w", "b", "", ""), (5, "w w", "b", "", "")]


def test_targets_are_met(spark):
    rows = sample()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = waterfill(sizes)
    got = pm.mix(spark.createDataFrame(rows, SCHEMA), cells=16).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 200


def test_targets_by_resharing(spark):
    rng = random.Random(12)
    for n in (1, 2, 5, 20, 21):
        for spread in (1, 3, 2000):
            sizes = {f"s{i}": rng.randrange(900, 1000) * rng.choice([1, spread]) for i in range(n)} | {None: 950}
            want = waterfill(sizes)
            got = {r.source: r.target for r in pm.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
            assert all(abs(got[s] - want[s]) < 1e-6 * want[s] for s in sizes) and abs(sum(got.values()) - sum(sizes.values())) < 1e-3


def test_cells_and_partitions_do_not_matter(spark):
    frame = spark.createDataFrame(sample(400), SCHEMA)
    runs = [pm.mix(frame, cells=1), pm.mix(frame.repartition(7), cells=4096)]
    a, b = (sorted(map(tuple, r.collect()), key=repr) for r in runs)
    assert a == b


def test_heavier_rows_are_likelier(spark):
    rows = [(i, "w w w w", "a" if i % 2 else "b", "x", "y") for i in range(2000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = pm.mix(frame, weight=F.when(F.col("doc_id") < 1000, 4)).filter("source = 'a'").collect()
    low = sum(r.copies for r in got if r.doc_id < 1000)
    high = sum(r.copies for r in got if r.doc_id >= 1000)
    assert 3.4 * high < low < 4.6 * high
    assert abs(sum(r.taken for r in got) - got[0].target) <= 4


def test_longer_documents_are_likelier_by_default(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([3, 200]), rng.choice("ab"), "x", "y") for i in range(3000)]
    got = [r for r in pm.mix(spark.createDataFrame(rows, SCHEMA)).collect() if r.source == "a"]
    mean = {n: sum(r.copies for r in got if r.size == n) / sum(r.size == n for r in got) for n in (3, 200)}
    assert 3.2 < mean[200] / mean[3] < 4.8  # eight binary digits against two
    assert abs(sum(r.taken for r in got) - got[0].target) <= 200


def test_mixed_repeats_rows(spark):
    frame = spark.createDataFrame(sample(300) + [(77, "w w", "rep", "x", "y")] * 101, SCHEMA)
    want = {}
    for r in pm.mix(frame).collect():
        k = (r.doc_id, r.size, r.source)
        want[k] = want.get(k, 0) + r.copies * (r.size > 0)
    rows = pm.mixed(frame).collect()
    seen = dict.fromkeys(want, 0)
    for r in rows:
        seen[r.doc_id, len(r.text.split()), r.source] += 1
    assert seen == want
    assert list(rows[0].asDict()) == frame.columns


def test_empty(spark):
    assert pm.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pm.mix(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()[0].taken == 0
