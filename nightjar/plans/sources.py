"""Registered scans: a lane is written out as log lines by Spark and parsed back, against the lane itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.functions.frames import once
from nightjar.plans.projections import conn, pihole, syslog, with_lanes
from nightjar.registry import register
from nightjar.sources import text

AS_OF = 1_706_659_200.0  # 2024-01-31


def _lines(df, value):
    return df.select(F.lit("/logs/box.log").alias("file"), value.alias("value"))


def _stamp(ts):
    at = F.timestamp_seconds(F.floor(ts))
    return F.concat(F.date_format(at, "MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss"))


_CONN = "SELECT src, dst, port, proto, ts, bytes, resp_bytes, duration, conn_state, NULL::BOOLEAN AS local_orig FROM conn"


@register("scan_zeek_ndjson", with_lanes(_CONN, "conn"))
def scan_zeek_ndjson(spark, sf_dir):
    lane = conn(spark, sf_dir)
    body = F.to_json(F.struct("ts", F.col("src").alias("id.orig_h"), F.col("dst").alias("id.resp_h"), F.col("port").alias("id.resp_p"), "proto", F.col("bytes").alias("orig_bytes"), "resp_bytes", "duration", "conn_state"))
    junk = lane.select(F.lit("/logs/box.log").alias("file"), F.element_at(F.array(F.lit("# a comment"), F.lit("{broken"), F.lit("[1]"), F.lit('{"proto":"tcp"}')), (F.col("row_id") % 4 + 1).cast("int")).alias("value"))
    return text.zeek_ndjson(_lines(lane, body).unionByName(junk), text.CONN_WIRE, "conn")


@register("scan_zeek_tsv", with_lanes(_CONN, "conn"))
def scan_zeek_tsv(spark, sf_dir):
    lane = conn(spark, sf_dir)
    names = ["ts", "id.orig_h", "id.resp_h", "id.resp_p", "proto", "orig_bytes", "resp_bytes", "duration", "conn_state"]
    cells = [F.coalesce(F.col(text.CONN_WIRE[n]).cast("string"), F.lit("-")) for n in names]
    head = lane.agg(F.count("*")).select(F.lit("/logs/box.log").alias("file"), F.lit("\t".join(["#fields", *names])).alias("value"))
    return text.zeek_tsv(_lines(lane, once(F.concat_ws("\t", *cells))).unionByName(head), text.CONN_WIRE, "conn")


@register("scan_syslog_text", with_lanes("SELECT floor(ts)::DOUBLE AS ts, host, program, program || '[*]: user ' || split_part(message, 'user ', 2) AS message FROM syslog", "syslog"))
def scan_syslog_text(spark, sf_dir):
    lane = syslog(spark, sf_dir)
    value = F.concat(_stamp(F.col("ts")), F.lit(" "), "host", F.lit(" "), F.expr("replace(message, '[*]', '[' || row_id || ']')"))
    return text.syslog_text(_lines(lane, value), AS_OF).select("ts", "host", "program", "message")


#: Resolver lines by row_id: what stands for each event type, and what is to be read from it
_SAID = (
    ("query", "'query[' || qtype || '] ' || query || ' from ' || src"), ("dhcp", "'DHCP 10.0.0.7 is box'"), ("dnssec_query", "'dnssec-query[DS] ' || query || ' to 9.9.9.9'"), ("forwarded", "'forwarded ' || query || ' to 9.9.9.9'"),
    ("reply", "'reply ' || query || ' is <CNAME>'"), ("cached", "'cached-stale ' || query || ' is 1.2.3.4'"), ("gravity_blocked", "'gravity blocked (cname) ' || query || ' is 0.0.0.0'"), ("special", "'special domain ' || query || ' is NXDOMAIN'"),
    ("pihole_hostname", "'Pi-hole hostname ' || query || ' is 10.0.0.2'"), ("regex_blocked", "'regex denied ' || query || ' is 0.0.0.0'"), ("regex_blocked", "'exactly blacklisted ' || query || ' is 0.0.0.0'"), ("regex_blocked", "'blacklisted ' || query || ' is 0.0.0.0'"),
    ("config", "'/etc/hosts ' || query || ' is 10.0.0.3'"), ("validation", "'validation result is SECURE'"), ("unknown", "'started, version 2.90'"),
)
_KIND = "CASE WHEN event_type = 'query' THEN 'query' ELSE " + "CASE row_id % 15 " + " ".join(f"WHEN {i} THEN '{k if k != 'query' else 'forwarded'}'" for i, (k, _) in enumerate(_SAID)) + " END END"


@register("scan_dnsmasq_text", with_lanes(f"""k AS (SELECT *, {_KIND} AS kind FROM pihole)
  SELECT floor(ts)::DOUBLE AS ts, src, CASE WHEN kind NOT IN ('dhcp', 'validation', 'unknown') THEN query END AS query, kind AS event_type, CASE kind WHEN 'query' THEN qtype WHEN 'dnssec_query' THEN 'DS' END AS qtype,
  CASE WHEN row_id % 4 = 0 THEN 'box' ELSE 'pi' END AS host FROM k""", "pihole"))
def scan_dnsmasq_text(spark, sf_dir):
    lane = pihole(spark, sf_dir)
    other = "CASE row_id % 15 " + " ".join(f"WHEN {i} THEN {said if kind != 'query' else _SAID[3][1]}" for i, (kind, said) in enumerate(_SAID)) + " END"
    said = F.when(F.col("event_type") == "query", F.expr(_SAID[0][1])).otherwise(F.expr(other))
    host = F.expr("if(row_id % 4 = 0, ' ', ' pi ')")
    junk = lane.select(F.lit("/logs/box.log").alias("file"), F.expr("element_at(array('# Jan  1 dnsmasq[1]: x', '', 'Jan  1 00:00:00 pi sshd[3]: query[A] a from b'), cast(row_id % 3 + 1 as int))").alias("value"))
    return text.dnsmasq_text(_lines(lane, F.concat(_stamp(F.col("ts")), host, F.lit("dnsmasq[77]: "), said)).unionByName(junk), AS_OF)


@register("scan_journal_json", with_lanes("SELECT floor(ts * 1000) / 1000 AS ts, host, program, message AS raw, program || '[*]: ' || message AS message FROM syslog", "syslog"))
def scan_journal_json(spark, sf_dir):
    lane = syslog(spark, sf_dir)
    micros = (F.floor(F.col("ts") * 1000) * 1000).cast("string")
    body = F.to_json(F.struct(micros.alias("__REALTIME_TIMESTAMP"), F.col("message").alias("MESSAGE"), F.col("host").alias("_HOSTNAME"), F.col("program").alias("SYSLOG_IDENTIFIER"), F.lit("7").alias("_PID")))
    return text.journal_json(_lines(lane, body))[0]


@register("scan_cloudtrail_json", """SELECT epoch_us(ts) // 1000000 * 1.0::DOUBLE AS ts, event_type || '.amazonaws.com' AS event_source, CASE WHEN event_id % 2 = 0 THEN 'GetObject' ELSE 'PutObject' END AS event_name, 'u' || user_id AS principal,
  CASE WHEN event_id % 3 = 0 THEN 'service' ELSE 'interactive' END AS lane, CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS read_write FROM events""")
def scan_cloudtrail_json(spark, sf_dir):
    from nightjar.plans.projections import read

    e = read(spark, sf_dir, "events")
    who = F.struct(F.lit("IAMUser").alias("type"), F.expr("'u' || user_id").alias("userName"), F.expr("if(event_id % 3 = 0, 'x.amazonaws.com', null)").alias("invokedBy"))
    body = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.expr("event_type || '.amazonaws.com'").alias("eventSource"), F.expr("if(event_id % 2 = 0, 'GetObject', 'PutObject')").alias("eventName"), who.alias("userIdentity")))
    value = F.when(F.expr("event_id % 5 = 0"), F.concat(F.lit('{"Records":['), body, F.lit("]}"))).when(F.expr("event_id % 5 = 1"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return text.cloudtrail_json(_lines(e, value)).select("ts", "event_source", "event_name", "principal", "lane", "read_write")


@register("ts_policy_filter", with_lanes("SELECT row_id, ts FROM conn WHERE ts BETWEEN 1704500000 AND 1705500000", "conn"))
def ts_policy_filter(spark, sf_dir):
    return text.usable_ts(conn(spark, sf_dir), 1_704_500_000.0, 1_705_500_000.0).select("row_id", "ts")
