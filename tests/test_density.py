"""Density clusters against a brute-force hierarchy that works from the top down."""

import math
import random

import numpy as np
import pytest

from nightjar.operators.density import condensed_labels, density_clusters, lightest_forest


def brute(rows, least, samples):
    """{vector: smallest vector of its cluster, or None}, with recursion over all pairs."""
    points = sorted(set(rows))
    weight = {p: rows.count(p) for p in points}
    dist = {(a, b): math.dist(a, b) for a in points for b in points}
    core = {}
    for p in points:
        total = 0
        for q in sorted(points, key=lambda q: dist[p, q]):
            total += weight[q]
            if total >= min(samples, len(rows)):
                core[p] = dist[p, q]
                break
    reach = {(a, b): max(dist[a, b], core[a], core[b]) for a in points for b in points if a != b}

    def pieces(inside, below):
        left, out = set(inside), []
        while left:
            todo, seen = [left.pop()], []
            while todo:
                p = todo.pop()
                seen.append(p)
                near = [q for q in left if reach[p, q] < below]
                left.difference_update(near)
                todo += near
            out.append(frozenset(seen))
        return out

    def apart(inside):
        """The largest distance that holds a piece together, by growing it from one point."""
        inside = sorted(inside)
        near, most = {q: reach[inside[0], q] for q in inside[1:]}, 0.0
        while near:
            p = min(near, key=near.get)
            most = max(most, near.pop(p))
            near = {q: min(t, reach[p, q]) for q, t in near.items()}
        return most

    heavy = lambda s: sum(weight[p] for p in s)

    def descend(inside, birth):
        """(best stability, chosen clusters) below and with this cluster."""
        own, now, everyone = 0.0, inside, inside
        while True:
            if len(now) == 1:
                own += heavy(now) * (1e6 - birth)
                return max(own, 0), [everyone] if own >= 0 else []
            at = apart(now)
            parts = pieces(now, at)
            big = [s for s in parts if heavy(s) >= least]
            rate = 1 / max(at, 1e-6)
            if len(big) == 1:
                own += sum(heavy(s) for s in parts if s not in big) * (rate - birth)
                now = big[0]
                continue
            own += heavy(now) * (rate - birth)
            if not big:
                return own, [everyone]
            found = [descend(s, rate) for s in big]
            under = sum(f[0] for f in found)
            return (own, [everyone]) if own >= under else (under, [c for f in found for c in f[1]])

    top = frozenset(points)
    while True:  # the root is never chosen
        if heavy(top) < least or len(top) == 1:
            chosen = []
            break
        at = apart(top)
        big = [s for s in pieces(top, at) if heavy(s) >= least]
        if len(big) == 1:
            top = big[0]
            continue
        chosen = [c for s in big for c in descend(s, 1 / max(at, 1e-6))[1]]
        break
    return {p: next((min(c) for c in chosen if p in c), None) for p in points}


def planted(seed):
    rng = random.Random(seed)
    rows = []
    for centre, spread, n in (((0, 0), 0.3, 22), ((6, 1), 1.2, 20), ((1, 7), 0.6, 14)):
        rows += [(round(rng.gauss(centre[0], spread), 1 if seed % 2 else 3), round(rng.gauss(centre[1], spread), 1 if seed % 2 else 3)) for _ in range(n)]
    rows += [(rng.uniform(-9, 15), rng.uniform(-9, 15)) for _ in range(7)]
    return rows + [(40.0, 40.0)] * (8 if seed % 3 == 0 else 2)


def test_against_brute_force(spark):
    """The whole operator, and the same tree merged in bands of a few edges."""
    rows = planted(0)
    want = brute(rows, 6, 4)
    frame = spark.createDataFrame(rows, "x double, y double")
    got = density_clusters(frame, ["x", "y"], least_size=6, samples=4, width=1.5).collect()
    assert len(got) == len(rows)
    low = {}
    for r in got:
        low[r.cluster] = min((r.x, r.y), low.get(r.cluster, (math.inf,)))
    assert {(r.x, r.y): None if r.cluster < 0 else low[r.cluster] for r in got} == want
    assert len({v for v in want.values() if v}) >= 3 and None in want.values()


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_in_bands(spark, seed):
    rows = planted(seed)
    want = brute(rows, 6, 4)
    points = sorted(set(rows))
    frame = spark.createDataFrame([(i, list(p), rows.count(p)) for i, p in enumerate(points)], "id long, v array<double>, n long")
    dist = {(a, b): math.dist(a, b) for a in points for b in points}
    core = {p: next(d for d, w in ((d, sum(rows.count(x) for x in points if dist[p, x] <= d)) for d in sorted(dist[p, q] for q in points)) if w >= 4) for p in points}
    joined, tree, edges = {0}, [], {i: (math.inf, 0) for i in range(len(points))}
    last = 0
    while len(joined) < len(points):
        for i in set(edges) - joined:
            edges[i] = min(edges[i], (max(dist[points[i], points[last]], core[points[i]], core[points[last]]), last))
        last = min(set(edges) - joined, key=edges.get)
        joined.add(last)
        tree.append((edges[last][0], edges[last][1], last))
    for band in (500_000, 20):
        labels = {r.id: r.label for r in condensed_labels(frame, spark.createDataFrame(tree, "w double, a long, b long"), 6, band=band).collect()}
        low = {}
        for i, label in labels.items():
            low[label] = min(points[i], low.get(label, (math.inf,)))
        assert {p: low.get(labels.get(i)) for i, p in enumerate(points)} == want


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1.0, None), (None, 1.0), (float("nan"), 0.0), (0.0, 0.0), (-0.0, 0.0)], "x double, y double")
    assert {r.cluster for r in density_clusters(frame, ["x", "y"], 2, 2).collect()} == {-1}
    assert density_clusters(frame.limit(0), ["x", "y"]).count() == 0


def test_forest_by_rounds(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w), int(a), int(b)) for a, b, w in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(1, 30, 300), strict=True)]
    frame = spark.createDataFrame(edges, "p long, q long, w double, a long, b long")
    ends = lambda df: sorted((r.w, r.a, r.b) for r in df.collect())
    assert ends(lightest_forest(frame, 5)) == ends(lightest_forest(frame))


def test_names_are_scored_once(spark):
    """The clusters and the report read rows that have their score: nothing after that works it out again."""
    from __spark_entry__ import queries
    from tests.conftest import SF

    for name in ("density_noise", "dns_dense_scan"):
        plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "md5" not in plan, name


def test_dense_scan_shares(spark):
    """A cluster counts by its size, its share of high scores and its first domain's share; rows without a score are no part of the second."""
    from nightjar.operators.mining import dense_scan

    rows = [(0, "a.com", f"x{i}.a.com", 2.0 if i < 3 else 0.1) for i in range(4)] + [(0, "b.com", "y.b.com", None)]
    rows += [(1, "b.com", f"y{i}.b.com", 2.0 if i < 1 else 0.1) for i in range(4)] + [(2, f"c{i}.com", f"z.c{i}.com", 2.0) for i in range(4)] + [(-1, "a.com", f"w{i}.a.com", 2.0) for i in range(4)]
    frame = spark.createDataFrame(rows, "cluster int, domain string, query string, s double")
    got = dense_scan(frame, frame["s"], least=4, high=1.8, high_share=0.75, domain_share=0.75).collect()
    assert [tuple(r) for r in got] == [(f"x{i}.a.com", 0, "a.com", 2.0, 1) for i in range(3)]
