"""Choice of files before reading, against walking each family file by file."""

import gzip
import random

from pyspark.sql import functions as F

from nightjar.sources import inventory

SCHEMA = "pattern string, file string, first_ts double"


def _walk(files, ranks, since, until):
    """chosen by definition: files of one orderable family, (rank, name, first_ts)."""
    keep, before, stop = set(), None, False
    for name in sorted(files, key=lambda n: (ranks[n], n)):
        ts = files[name]
        if stop:
            continue
        if ts is not None:
            if before is not None and ts > before:
                return None
            before = ts
            if until is not None and ts > until:
                continue
            if since is not None and ts < since:
                stop = True
        keep.add(name)
    return keep


def test_families_against_walking(spark):
    draw, rows, want = random.Random(2), [], {}
    for p in range(40):
        files, ranks, whole = {}, {}, set()
        for i in range(draw.randint(1, 9)):
            ts = None if draw.random() < 0.15 else float(1000 - 100 * i + (draw.choice([0, 0, 0, 0, 150]) if p % 3 == 0 else 0))
            name = "x.log" + (f".{i}" if i else "")
            files[name], ranks[name] = ts, i
        rows += [(f"p{p}", f"/logs/{name}", ts) for name, ts in files.items()]
        want[f"p{p}"] = (files, ranks)
    frame = inventory.named(spark.createDataFrame(rows, SCHEMA)).cache()
    for since, until in ((None, None), (450.0, 750.0), (700.0, None), (None, 500.0), (2000.0, 3000.0)):
        got = {}
        for r in inventory.choose(frame, since, until).collect():
            got.setdefault(r.pattern, {})[r["name"]] = (r.chosen, r.reason)
        for p, (files, ranks) in want.items():
            keep = _walk(files, ranks, since, until)
            reason = inventory.DISORDER if keep is None else None
            assert got[p] == {n: (keep is None or n in keep, reason) for n in files}, (p, since, until, files)


def test_ranks_of_names(spark):
    cases = {
        "pihole.log": ("pihole.log", 0, False), "pihole.log.2.gz": ("pihole.log", 2, False), "auth.log.20240131": ("auth.log", 99_999_999 - 20240131, False), "auth.log.20241331.xz": ("auth.log", 20241331, False),
        "dns_20240101_7d.log.gz": ("dns", 99_999_999 - 20240101, True), "dns_20240101_to_20240102_05h.log": ("dns", 99_999_999 - 20240101, True), "dns_20240101_0d.log": ("dns_20240101_0d.log", 0, False),
        "dns_20240105_to_20240102_05h.log": ("dns_20240105_to_20240102_05h.log", 0, False), "dns_20240199_7d.log": ("dns_20240199_7d.log", 0, False), "a_b_20240101_2d": ("a_b", 99_999_999 - 20240101, True), "x." + "9" * 45: ("x", 0, False),
    }
    got = inventory.rotations(inventory.named(spark.createDataFrame([("p", f"/l/{n}", 0.0) for n in cases], SCHEMA))).collect()
    assert {r["name"]: (r.base, int(r["rank"]), r.opens is not None) for r in got} == cases
    one = next(r for r in got if r["name"].startswith("dns_20240101_to"))
    assert one.closes - one.opens == 86400 + 6 * 3600


def _reasons(spark, *names):
    rows = [("p", f"/l/{n}", 1000.0) for n in names]
    return {r.reason for r in inventory.choose(inventory.named(spark.createDataFrame(rows, SCHEMA)), 5000.0, 6000.0).collect()}


def test_conflicts_keep_the_whole_pattern(spark):
    assert _reasons(spark, "a.log.1", "a.log.1.gz", "b.log", "b.log.1") == {inventory.DUPLICATE}
    assert _reasons(spark, "a_20240101_7d.log", "a_20240107_2d.log") == {inventory.OVERLAP}
    assert _reasons(spark, "a_20240101_7d.log", "a_20240101_7d.log.gz") == {inventory.OVERLAP}
    assert _reasons(spark, "a_20240101_7d.log", "a.1") == {inventory.OVERLAP}
    assert _reasons(spark, "a_20240101_7d.log", "a_20240108_2d.log", "a.log", "a.log.02", "a.log.2") == {None}
    none = inventory.named(spark.createDataFrame([], SCHEMA))
    assert inventory.choose(none, 1.0, 2.0).count() == 0


def test_primary_names_and_dated_folders(spark):
    names = ["/z/2024-01-01/conn.log", "/z/2024-01-02-a/conn.10.log.gz", "/z/2024-01-03/conn-summary.log", "/z/2024-01-03/conn_x.log", "/z/2024-13-45/conn.log", "/z/conn.log", "/z/2024-01-04/conn.log"]
    files = inventory.named(spark.createDataFrame([("p", n, 0.0) for n in names], SCHEMA))
    day = 1_704_067_200.0  # 2024-01-01
    kept = inventory.in_folders(inventory.primary(files, "conn"), day + 86400, day + 2 * 86400 + 5)
    assert {r.file for r in kept.collect()} == {names[1], names[4], names[5]}


def test_only_chosen_files_are_opened(spark, tmp_path):
    for i in range(6):  # rotation i holds the hour from 10000 - 1000 i on
        lines = "".join(f"{10000 - 1000 * i + k * 100} row\n" for k in range(10))
        if i:
            with gzip.open(tmp_path / f"app.log.{i}.gz", "wt") as f:
                f.write("# head\n\n" + lines)
        else:
            (tmp_path / "app.log").write_text(lines)
    listed = inventory.list_files(spark, [str(tmp_path), str(tmp_path)]).cache()
    assert listed.count() == 6
    lines = spark.read.text([r.file for r in listed.collect()]).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("line"))
    at = F.regexp_extract("value", r"^(\d+) ", 1).cast("double")
    times = inventory.first_times(lines, at)
    assert sorted(r.first_ts for r in times.collect()) == [5000.0 + 1000 * i for i in range(6)]
    path = lambda c: F.regexp_replace(c, "^file:/+", "/")
    held = listed.withColumn("file", path("file")).join(times.withColumn("file", path("file")), "file", "left")
    assert inventory.grown(held.filter("first_ts > 6000"), listed.withColumn("file", path("file"))).count() == 2
    chosen = inventory.choose(inventory.named(held.withColumn("pattern", F.lit("app"))), 7500.0, 8500.0)
    got = inventory.read_chosen(spark, chosen)
    assert len(got.inputFiles()) == 2 and sorted(f.rsplit("/", 1)[1] for f in got.inputFiles()) == ["app.log.2.gz", "app.log.3.gz"]
    assert sorted(int(r.value.split()[0]) for r in got.filter("value like '% row'").filter(at.between(7500, 8500)).collect()) == [7500, 7600, 7700, 7800, 7900, 8000, 8100, 8200, 8300, 8400, 8500]
    assert inventory.read_chosen(spark, chosen.limit(0)).count() == 0
