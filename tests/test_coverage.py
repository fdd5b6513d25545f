"""Coverage verdicts: real files bound to a manifest, and containment against a plain merge."""

import hashlib
import random

from pyspark.sql import functions as F

from nightjar.operators import coverage

ENTRY = "folder string, name string, size long, sha256 string, completion string, starts long, ends long"


def test_files_are_bound_to_their_manifest(spark, tmp_path):
    for name in ("good", "size", "digest", "partial", "unnamed"):
        (tmp_path / name).write_bytes(name.encode() * 100)
    files = coverage.hashed_files(spark, str(tmp_path)).cache()
    folder = files.first().folder
    sha = lambda name: hashlib.sha256(name.encode() * 100).hexdigest()
    rows = [(folder, "good", 400, sha("good").upper(), "success", 1, 5), (folder, "size", 401, sha("size"), "success", 1, 5), (folder, "digest", 600, sha("other"), "success", 1, 5), (folder, "partial", 700, sha("partial"), "failed", 1, 5)]
    entries, ok = spark.createDataFrame(rows, ENTRY), spark.createDataFrame([(folder, "ok")], "folder string, state string")
    reasons = lambda *a, **k: {r.name: r.reason for r in coverage.availability(files, *a, **k).collect()}
    assert reasons(ok, entries) == {"good": "trusted", "size": "binding_mismatch", "digest": "binding_mismatch", "partial": "incomplete", "unnamed": "entry_missing"}
    assert set(reasons(ok.limit(0), entries).values()) == {"manifest_missing"}
    assert set(reasons(ok.withColumn("state", F.lit("unreadable")), entries).values()) == {"manifest_unreadable"}
    assert set(reasons(ok, entries.unionByName(entries.limit(1))).values()) == {"manifest_malformed"}
    assert set(reasons(ok, entries, most=4).values()) == {"resource_limit"}
    assert coverage.availability(files.limit(0), ok, entries).count() == 0


def test_verdicts_against_a_plain_merge(spark):
    draw, facts, reports, want = random.Random(4), [], [], {}
    for feed in range(60):
        parts = [(a, a + draw.randint(0, 30)) for a in (draw.randrange(100) for _ in range(draw.randint(0, 9)))]
        told = draw.random() < 0.9
        facts += [(feed, told or i > 0, a if told or i > 0 else None, b if told or i > 0 else None) for i, (a, b) in enumerate(parts)]
        lo, hi = sorted(draw.choices(range(140), k=2))
        reports.append((feed, lo, hi, None))
        reach = sorted(parts)
        islands = []
        for a, b in reach:
            if islands and a <= islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b])
        sound = told and all(b > a for a, b in parts)
        want[feed] = "interval_unbounded" if hi <= lo else "no_objects" if not parts else "object_unknown" if not sound else "complete" if any(a <= lo and b >= hi for a, b in islands) else "interval_gap"
    facts = spark.createDataFrame(facts, "feed int, trusted boolean, starts long, ends long")
    told = coverage.verdicts(spark.createDataFrame(reports, "feed int, starts long, ends long, since long"), facts, ["feed"])
    assert {r.feed: r.why for r in told.collect()} == want and "complete" in want.values()


def test_covered_periods_count_back_from_the_end(spark):
    day = 86_400
    facts = spark.createDataFrame([(1, True, 0, 2 * day), (1, True, 2 * day, 3 * day + 1), (1, True, 4 * day, 9 * day)], "feed int, trusted boolean, starts long, ends long")
    reports = spark.createDataFrame([(1, 8 * day, 9 * day, 0), (2, 8 * day, 9 * day, 0)], "feed int, starts long, ends long, since long")
    seen = spark.createDataFrame([(1, 5), (2, 3), (2, 3)], "feed int, period int")
    told = coverage.verdicts(reports, facts, ["feed"])
    assert sorted(tuple(r) for r in coverage.covered_periods(told, facts, ["feed"], seen).collect()) == [(1, p) for p in (0, 1, 2, 3, 4, 6, 7, 8)] + [(2, 3)]
