"""Budgets of the cube's fold, against trying every limit."""

import random

from pyspark.sql import functions as F

from nightjar.operators import cube

SCHEMA = "row_id long, ts double, src string, dst string, svc string, metric double, duration double"


def _rows(seed, n, hosts=12, services=6):
    draw = random.Random(seed)
    some = lambda kind, most: f"{kind}{min(int(draw.expovariate(0.25)), most)}"
    return [(i, draw.random() * 100_000, some("s", hosts) if draw.random() < 0.95 else None, some("d", hosts), some("v", services), float(draw.randrange(50)), draw.choice([0.0, draw.random() * 4000])) for i in range(n)]


def _ranks(rows, at):
    sums = {}
    for r in rows:
        if r[at] is not None:
            m, c = sums.get(r[at], (0.0, 0))
            sums[r[at]] = (m + r[5], c + 1)
    order = sorted(sums, key=lambda k: (-sums[k][0], -sums[k][1], k))
    return {k: i + 1 for i, k in enumerate(order)}


def _fold(rows, h, v):
    ranks = [_ranks(rows, at) for at in (2, 3, 4)]
    keep = lambda r, i, most: r[2 + i] if ranks[i].get(r[2 + i], most + 1) <= most else cube.OTHER
    return [(keep(r, 0, h), keep(r, 1, h), keep(r, 2, v), *r[1:2], r[6]) for r in rows]


def test_curves_count_every_limit(spark):
    for seed, n in ((1, 300), (3, 1)):
        rows = _rows(seed, n)
        frame = spark.createDataFrame(rows, SCHEMA).withColumns({"rows": F.lit(1), "bin": F.floor(F.col("ts") / 20_000)})
        places = cube.ranked(frame, 10, 5)
        for by, key in (((), lambda r: ()), (("bin",), lambda r: (int(r[1] // 20_000),))):
            kinds = {"services": [(10, v) for v in range(1, 6)], "hosts": [(h, 2) for h in range(1, 11)]}
            for kind, limits in kinds.items():
                want = [len({(*f[:3], *key(r)) for f, r in zip(_fold(rows, h, v), rows, strict=True)}) for h, v in limits]
                got = [r.groups for r in cube.limit_curve(places, kind, 10, 5 if kind == "services" else 2, by).orderBy("limit").collect()]
                assert got == want, (seed, kind, by)


def test_fit_stays_in_budget_and_one_step_more_does_not(spark):
    rows = _rows(7, 400)
    frame = spark.createDataFrame(rows, SCHEMA)
    flows = lambda h, v: len({f[:3] for f in _fold(rows, h, v)})
    for budget in (150, 60, 8):
        cells, fit = cube.fit_budget(frame, 3600, 10, 5, budget, 10**6)
        assert fit.width == 3600 and cells.select("src", "dst", "svc").distinct().count() == flows(fit.hosts, fit.services)
        if budget >= 8:
            assert flows(fit.hosts, fit.services) <= budget
        if fit.services < 5 and fit.hosts == 10:
            assert flows(10, fit.services + 1) > budget
        if fit.hosts < 10:
            assert flows(10, 1) > budget and fit.services == 1 and flows(fit.hosts + 1, 1) > budget


def test_bins_widen_until_cells_fit(spark):
    frame = spark.createDataFrame(_rows(9, 300), SCHEMA)
    for budget in (400, 100):
        cells, fit = cube.fit_budget(frame, 60, 10, 5, 10**6, budget)
        assert cells.count() <= budget and fit.start == frame.agg(F.min("ts")).first()[0]
        assert abs(cells.agg(F.sum("rows")).first()[0] - 300) == 0
    assert fit.width > 60
    cells, fit = cube.fit_budget(frame, 60, 10, 5, 10**6, 9)  # not even one bin fits: identities are folded farther
    assert fit.width == cube.pick_bin(100_000, 1) and fit.services < 5 and cells.count() <= 9


def test_empty_and_corrupt_durations(spark):
    none, fit = cube.fit_budget(spark.createDataFrame([], SCHEMA), 60)
    assert none.count() == 0 and (fit.hosts, fit.services, fit.start) == (cube.HOSTS, cube.SERVICES, None)
    rows = [(1, 0.0, "a", "b", "c", 8.0, 1e15), (2, 100.0, "a", "b", "c", 1.0, 0.0)]
    cells, _ = cube.fit_budget(spark.createDataFrame(rows, SCHEMA), 60)
    assert sorted(r.bin for r in cells.collect()) == [0, 1]


def test_widths():
    assert [cube.pick_bin(s, t) for s, t in ((0, 10), (100, 11), (101, 11), (60, 1), (604_800, 1), (604_799, 1), (10**7, 2))] == [1, 10, 30, 300, 1_209_600, 604_800, 17 * 604_800]
