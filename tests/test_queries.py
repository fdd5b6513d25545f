"""Every registered log query against its DuckDB SQL, and the behaviour of operators on planted rows."""

import math
import random

import pytest

from nightjar import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    if name in ORACLES:
        compare(spark, name, QUERIES[name], ORACLES[name], SF)
    else:
        assert QUERIES[name](spark, SF).columns


def test_planted_beacon(spark):
    from nightjar.operators.conn import beacon_score

    rng = random.Random(4)
    rows = [(i, "10.0.0.1", "203.0.113.9", 443, "tcp", 1_700_000_000.0 + 180 * i + rng.uniform(0, 5), 500) for i in range(480)]
    rows += [(1000 + i, "10.0.0.2", "203.0.113.9", 443, "tcp", 1_700_000_000.0 + rng.uniform(0, 86_400), 500) for i in range(480)]
    frame = spark.createDataFrame(rows, "row_id long, src string, dst string, port int, proto string, ts double, bytes long")
    got = beacon_score(frame).collect()
    by = {r.src: r for r in got}
    assert abs(by["10.0.0.1"].period - 180) < 1 and by["10.0.0.1"].score > 0.3 > by["10.0.0.2"].score


def test_gap_is_split_at_exactly_the_gap(spark):
    from nightjar.operators.windows import gap_sessions

    frame = spark.createDataFrame([("a", 0.0, 0), ("a", 59.9, 1), ("a", 119.9, 2), ("b", 0.0, 3)], "k string, ts double, row_id long")
    got = {r.row_id: r.session for r in gap_sessions(frame, ["k"], "ts", 60.0, ["row_id"]).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1}


def test_distinct_in_range_counts_its_ends(spark):
    from nightjar.operators.windows import most_distinct_in_range

    rows = [("a", "x", 0.0), ("a", "y", 100.0), ("a", "x", 100.0), ("a", "z", 200.0), ("a", "w", 200.1), ("b", None, 1.0)]
    got = most_distinct_in_range(spark.createDataFrame(rows, "k string, v string, ts double"), ["k"], "v", "ts", 100.0, "n").collect()
    assert [(r.k, r.n) for r in got] == [("a", 3)]


def test_addresses(spark):
    from nightjar.functions.net import classify_addresses

    rows = [("10.1.2.3",), ("::ffff:10.0.0.1",), ("8.8.8.8",), ("224.0.0.1",), ("2001:db8::1",), ("fe80::1",), ("256.1.1.1",), ("junk",), (None,)]
    got = {r.a: tuple(r.a_facts) for r in classify_addresses(spark.createDataFrame(rows, "a string"), "a").collect()}
    assert got["10.1.2.3"] == (True, True, False, False) and got["::ffff:10.0.0.1"] == (True, True, False, False)
    assert got["8.8.8.8"] == (True, False, False, True) and got["224.0.0.1"] == (True, False, True, False)
    assert got["2001:db8::1"] == (True, False, False, True) and got["fe80::1"] == (True, False, True, False)
    assert not got["256.1.1.1"][0] and not got["junk"][0] and not got[None][0]


def test_registrable_domain(spark):
    from pyspark.sql import functions as F

    from nightjar.functions.net import label_score, name_domains

    names = {"a.b.example.co.uk": "example.co.uk", "example.com.": "example.com", "com": "com", "co.uk": "uk", "x.foo.ck": "x.foo.ck", "y.x.foo.ck": "x.foo.ck", "a.www.ck": "www.ck", "host": "host", "n.fam.lan": "lan", "b.lan": "lan", "a..Foo.com.TR": "foo.com.tr", "": None, " . ": None}
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.domain for r in name_domains(frame).collect()} == names
    score = spark.createDataFrame([("google",), ("x7f3k9q2",), ("",), (None,)], "n string").select("n", label_score(F.col("n")).alias("s")).collect()
    by = {r.n: r.s for r in score}
    assert by["x7f3k9q2"] > by["google"] and by[""] == 0 and by[None] == 0 and not math.isnan(by["google"])


def test_suffix_list_format(spark, tmp_path):
    from nightjar.functions.net import name_domains, suffix_rules

    (tmp_path / "list.dat").write_text("// a comment\n\ncom\n*.ck\n!www.ck\nLAN  rest\n")
    rules = suffix_rules(spark, str(tmp_path / "list.dat"))
    assert {(r.rule, r.kind) for r in rules.collect()} == {("com", "plain"), ("ck", "wildcard"), ("www.ck", "exception"), ("lan", "plain")}
    got = {r.name: r.domain for r in name_domains(spark.createDataFrame([("a.b.lan",), ("a.b.co.uk",)], "name string"), rules).collect()}
    assert got == {"a.b.lan": "b.lan", "a.b.co.uk": "uk"}


def test_flow_rules(spark):
    from nightjar.operators.conn import FlowRule, suppress_flows

    rows = [(1, "10.0.0.1", "8.8.8.8"), (2, "8.8.8.8", "10.0.0.1"), (3, "2001:db8:1::5", "10.0.0.9"), (4, "::ffff:10.0.0.1", "9.9.9.9"), (5, None, "8.8.4.4"), (6, "x", "y"), (7, "fe80::1", "ff02::fb")]
    frame = spark.createDataFrame([(*r, 53, "udp") for r in rows], "row_id int, src string, dst string, port int, proto string")
    kept = lambda *rules, detector=None: {r.row_id for r in suppress_flows(frame, rules, detector).collect()}
    assert kept(FlowRule("10.0.0.1", "8.8.8.0/24")) == {3, 4, 5, 6, 7}
    assert kept(FlowRule("10.0.0.0/24")) == {5, 6, 7}  # networks hold IPv4 in IPv6 form as well
    assert kept(FlowRule("2001:db8::/32", "*")) == {1, 2, 4, 5, 6, 7}
    assert kept(FlowRule("*", "*", 53)) == set() and kept(FlowRule("*", "*", 54)) == {1, 2, 3, 4, 5, 6, 7}
    assert kept(FlowRule(port=53, proto="tcp")) == {1, 2, 3, 4, 5, 6, 7} and kept(FlowRule(port=53, proto="udp")) == set()
    assert kept(FlowRule("x", detectors=("scan",))) == {1, 2, 3, 4, 5, 6, 7} and kept(FlowRule("x", detectors=("scan",)), detector="scan") == {1, 2, 3, 4, 5, 7}
    assert kept(FlowRule("not/a/network")) == {1, 2, 3, 4, 5, 6, 7}


def test_pools_of_both_versions(spark):
    from nightjar.operators.conn import exfil_pools

    rows = [("a", f"2001:db8:0:{i}::1", 5) for i in range(6)] + [("a", f"203.0.{113 + i}.9", 7) for i in range(4)] + [("a", "9.9.9.9", 1), ("b", "2001:db8::1", 2)]
    frame = spark.createDataFrame([(*r, 0, 1, 0.0, 1.0) for r in rows], "src string, dst string, orig_bytes long, resp_bytes long, connections long, first_ts double, last_ts double")
    got = {(r.src, r.target): (r.tier, r.destinations, r.orig_bytes) for r in exfil_pools(frame).collect()}
    assert got == {("a", "2001:0db8:0000:0000:0000:0000:0000:0000/40"): ("destination_pool", 6, 30), ("a", "203.0.112.0/20"): ("destination_pool", 4, 28), ("a", "9.9.9.9"): ("pair", 1, 1), ("b", "2001:db8::1"): ("pair", 1, 2)}


def test_pools_work_out_their_pairs_once(spark):
    """F8: the pairs stand in the plan several times, the work below them is done once."""
    from nightjar.operators.conn import exfil_pools

    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    made = spark.range(0, 12, 1, 3).selectExpr("'a' AS src", "concat('203.0.113.', id) AS dst", "id AS orig_bytes", "id AS resp_bytes", "1L AS connections", "0D AS first_ts", "1D AS last_ts")
    assert [r.destinations for r in exfil_pools(made.mapInPandas(counting, made.schema)).collect()] == [12] and seen.value == 12
