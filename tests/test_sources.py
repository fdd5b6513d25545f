"""Grammar matrices and edge cases of the text sources."""

import json

from nightjar.sources import text, zeek

AS_OF = 1_706_659_200.0  # 2024-01-31


def lines(spark, values, file="/logs/gate.log"):
    return spark.createDataFrame([(file, v) for v in values], "file string, value string")


def test_resolver_grammar(spark):
    said = {
        "query[A] Example.COM from 192.168.1.5": ("query", "example.com", "192.168.1.5", "A"),
        "forwarded example.com to 9.9.9.9": ("forwarded", "example.com", None, None),
        "reply example.com is 1.2.3.4": ("reply", "example.com", None, None),
        "cached example.com is 1.2.3.4": ("cached", "example.com", None, None),
        "gravity blocked ads.test is 0.0.0.0": ("gravity_blocked", "ads.test", None, None),
        "regex blacklisted ads.test is 0.0.0.0": ("regex_blocked", "ads.test", None, None),
        "something else": ("unknown", None, None, None),
    }
    rows = text.dnsmasq_text(lines(spark, [f"Jan  2 03:04:05 pi dnsmasq[12]: {s}" for s in said]), AS_OF).collect()
    assert sorted(((r.event_type, r["query"], r.src, r.qtype) for r in rows), key=repr) == sorted(said.values(), key=repr)
    assert {(r.ts, r.host) for r in rows} == {(1_704_164_645.0, "pi")}


def test_syslog_stamps_hosts_and_years(spark):
    rows = text.syslog_text(lines(spark, ["<13>Jan  2 03:04:05 box sshd[99]: hello", "2024-01-02T03:04:05Z box cron: x", "Dec 31 00:00:00 box su: y", "no stamp at all", "", "Feb 30 00:00:00 box bad: z"]), AS_OF).collect()
    got = {r.raw: (r.ts, r.host, r.program, r.message) for r in rows}
    assert got["<13>Jan  2 03:04:05 box sshd[99]: hello"] == (1_704_164_645.0, "box", "sshd", "sshd[*]: hello")
    assert got["2024-01-02T03:04:05Z box cron: x"][:3] == (1_704_164_645.0, "box", "cron")
    assert got["Dec 31 00:00:00 box su: y"][0] == 1_703_980_800.0  # the year before
    assert got["no stamp at all"] == (None, "gate", "unknown", "no stamp at all")
    assert got["Feb 30 00:00:00 box bad: z"][0] is None and len(got) == 5


def test_zeek_encodings_agree(spark):
    good = {"ts": 1.5, "id.orig_h": "10.0.0.1", "id.resp_h": "8.8.8.8", "query": "a.test", "qtype": 1, "rcode": 0, "TTLs": [60.0, 5.0], "answers": ["1.2.3.4", "5.6.7.8"], "TC": False, "qclass": 1}
    ndjson = text.zeek_ndjson(lines(spark, [json.dumps(good), "#x", "", "nope", "[]", json.dumps(good | {"ts": None})]), text.DNS_WIRE, "dns").drop("qclass").collect()
    cell = lambda v: "-" if v is None else "T" if v is True else "F" if v is False else ",".join(map(str, v)) if isinstance(v, list) else str(v)
    tsv = ["#separator \\x09", "\t".join(["#fields", *good]), "\t".join(cell(v) for v in good.values()), "too\tfew", "\t".join("-" for _ in good)]
    assert [tuple(r) for r in ndjson] == [tuple(r) for r in text.zeek_tsv(lines(spark, tsv), text.DNS_WIRE, "dns").drop("qclass").collect()]
    assert len(ndjson) == 1 and ndjson[0].answer == ["1.2.3.4", "5.6.7.8"] and ndjson[0].tc is False


def test_journal_rejects_by_reason(spark):
    ok = {"__REALTIME_TIMESTAMP": "1704164645000000", "MESSAGE": "hi", "_HOSTNAME": "h", "SYSLOG_IDENTIFIER": "p", "_PID": "4"}
    values = [json.dumps(ok), json.dumps(ok | {"MESSAGE": [104, 105]}), "broken", json.dumps({"MESSAGE": "x"}), json.dumps(ok | {"MESSAGE": None})]
    kept, refused = text.journal_json(lines(spark, values))
    assert [(r.ts, r.host, r.program, r.raw, r.message) for r in kept.collect()] == [(1_704_164_645.0, "h", "p", "hi", "p[*]: hi")] * 2
    assert {r.reason: r.rows for r in refused.collect()} == {"malformed": 1, "no_time": 1, "no_message": 1}


def test_cloud_principals(spark):
    def event(who, **more):
        return {"eventTime": "2024-01-02T03:04:05Z", "eventName": "GetObject", "userIdentity": who, **more}

    role = {"type": "AssumedRole", "arn": "arn:aws:sts::1:assumed-role/R/s", "sessionContext": {"sessionIssuer": {"arn": "arn:aws:iam::1:role/aws-service-role/x/AWSServiceRoleForX", "userName": "R"}}}
    docs = [json.dumps({"Records": [event({"type": "Root"}), event({"type": "IAMUser", "userName": "ann"}, readOnly=False)]}), json.dumps([event(role)]), json.dumps(event({"type": "AWSService", "invokedBy": "ec2.amazonaws.com"}, eventName="PutX")), "junk"]
    rows = text.cloudtrail_json(lines(spark, docs)).collect()
    assert sorted((r.principal, r.lane, r.read_write) for r in rows) == [("R", "service", "read"), ("ann", "interactive", "write"), ("ec2.amazonaws.com", "service", "write"), ("root", "interactive", "read")]


def test_routing_and_windows(spark):
    frame = lines(spark, ['{"conn_state":"SF"}'], "a").unionByName(lines(spark, ["Jan  2 03:04:05 pi dnsmasq[1]: query[A] x from y"], "b")).unionByName(lines(spark, ["Jan  2 03:04:05 box su: y"], "c")).unionByName(lines(spark, ["???"], "d"))
    assert {r.file: r.lane for r in text.route(frame).collect()} == {"a": "conn", "b": "pihole", "c": "syslog", "d": "blob"}
    times = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (float("inf"),), (float("nan"),)], "ts double")
    assert sorted(r.ts for r in text.usable_ts(times, 1.0, 2.0).collect()) == [1.0, 2.0]
    assert sorted((r.ts for r in text.usable_ts(times, 2.0, None, keep_null=True).collect()), key=repr) == [2.0, 3.0, None]
    paths = spark.createDataFrame([("/z/2024-01-02/conn.log",), ("/z/2024-02-02/conn.log",), ("/z/conn.log",)], "file string")
    assert {r.file for r in text.in_dates(paths, "2024-01-01", "2024-01-31").collect()} == {"/z/2024-01-02/conn.log", "/z/conn.log"}


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("scan", "HIGH", "=cmd()", "{}", float("nan")), ("dns", "LOW", "x", "{}", 1.5)], "detector string, severity string, title string, evidence string, score double")
    text.write_json(found, str(tmp_path / "j"))
    assert sorted((r.score for r in spark.read.schema("score double").json(str(tmp_path / "j")).collect()), key=repr) == [1.5, None]
    text.write_worklist(found, str(tmp_path / "c"))
    assert {r.title for r in spark.read.option("header", "true").csv(str(tmp_path / "c")).collect()} == {"'=cmd()", "x"}


def test_separated_sensor_lines_of_one_file_stay_in_many_tasks(spark):
    """the lines meet their file's header where they are, they aren't dealt by file, and a line is split once."""
    head = [r"#separator \x7c", "#unset_field|-", "#fields|ts|id.orig_h|id.resp_h|id.resp_p|cert_chain_fps|server_name"]
    said = lines(spark, [*head, *[f"{i}|10.0.0.1|8.8.8.8|443|a,b|s{i}" for i in range(40)], "1|2", "41|-|8.8.8.8|x|(empty)|"]).repartition(4)
    lane = zeek.lane(said, "ssl", tsv=True)
    plan = lane._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file" not in plan.split("InMemoryRelation")[0] and "BroadcastHashJoin" in plan and plan.split("InMemoryRelation")[0].count("split(value") == 1
    rows = {r.ts: r for r in lane.collect()}
    assert len(rows) == 41 and rows[7.0].sni == "s7" and rows[7.0].cert_fp == "a" and rows[7.0].port == 443 and rows[7.0].cipher is None
    assert rows[41.0].src is None and rows[41.0].port is None and rows[41.0].cert_fp is None and rows[41.0].sni == ""


def test_separators_that_patterns_would_read(spark):
    for sign, code in (("|", r"\x7c"), (".", r"\x2e"), ("\\", r"\x5c"), ("a", r"\x61"), ("\t", r"\x09"), ("^", r"\x5e"), ("_", r"\x5f"), ("é", "é"), ("||", "||")):
        made = zeek.lane(lines(spark, [f"#separator {code}", sign.join(["#fields", "ts", "nxme"]).replace("nxme", "source"), sign.join(["5", "Q"])]), "weird", tsv=True)
        assert [(r.ts, r.source) for r in made.collect()] == [(5.0, "Q")], sign


def test_separated_flow_lines_of_one_file_stay_in_many_tasks(spark):
    """no task reads all lines of a file."""
    names = ["ts", "id.orig_h", "id.resp_h", "id.resp_p", "proto", "orig_bytes"]
    said = lines(spark, ["\t".join(["#fields", *names]), *["\t".join([str(i), "10.0.0.1", "8.8.8.8", "53", "udp", "-"]) for i in range(40)], "x\ty"]).repartition(4)
    lane = text.zeek_tsv(said, text.CONN_WIRE, "conn")
    plan = lane._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "hashpartitioning(file" not in plan and "BroadcastHashJoin" in plan and plan.count("split(value") == 1
    rows = lane.collect()
    assert sorted(r.ts for r in rows) == [float(i) for i in range(40)] and {(r.src, r.port, r.bytes, r.duration) for r in rows} == {("10.0.0.1", 53, None, None)}
