"""Registered queries on the result shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.functions import text
from nightjar.operators import conn as conn_ops
from nightjar.operators import findings as ops
from nightjar.plans.projections import conn, read, rough, with_lanes
from nightjar.plans.conn import _LOCAL
from nightjar.registry import register

_SCANS = """x AS (SELECT 'horizontal' AS scan_type, src, NULL::VARCHAR AS dst, port, NULL::BIGINT AS distinct_ports, count(DISTINCT dst) AS distinct_hosts, round_even(avg((conn_state IN ('S0', 'REJ', 'RSTO'))::INTEGER), 3) AS state_ratio FROM conn GROUP BY ALL
  UNION ALL SELECT 'vertical', src, dst, NULL, count(DISTINCT port), NULL, round_even(avg((conn_state IN ('S0', 'REJ', 'RSTO'))::INTEGER), 3) FROM conn GROUP BY ALL
  UNION ALL SELECT 'slow', src, NULL, NULL, count(DISTINCT port), count(DISTINCT dst), round_even(avg((conn_state IN ('S0', 'REJ', 'RSTO'))::INTEGER), 3) FROM conn GROUP BY ALL)"""


def _scans(spark, sf_dir):
    lane = conn(spark, sf_dir)
    ratio = F.bround(F.avg(F.col("conn_state").isin("S0", "REJ", "RSTO").cast("double")), 3).alias("state_ratio")
    none = F.lit(None).cast("long")
    wide = lane.groupBy("src", "port").agg(F.countDistinct("dst").alias("distinct_hosts"), ratio).select(F.lit("horizontal").alias("scan_type"), "src", F.lit(None).cast("string").alias("dst"), "port", none.alias("distinct_ports"), "distinct_hosts", "state_ratio")
    tall = lane.groupBy("src", "dst").agg(F.countDistinct("port").alias("distinct_ports"), ratio).select(F.lit("vertical").alias("scan_type"), "src", "dst", F.lit(None).cast("int").alias("port"), "distinct_ports", none.alias("distinct_hosts"), "state_ratio")
    slow = lane.groupBy("src").agg(F.countDistinct("port").alias("distinct_ports"), F.countDistinct("dst").alias("distinct_hosts"), ratio).select(F.lit("slow").alias("scan_type"), "src", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("int").alias("port"), "distinct_ports", "distinct_hosts", "state_ratio")
    return wide.unionByName(tall).unionByName(slow)


_CLASSES = _SCANS + """, g AS (SELECT *, coalesce(distinct_hosts, 0) AS h, greatest(coalesce(distinct_ports, 0), coalesce(distinct_hosts, 0)) AS b, state_ratio AS r FROM x),
  t AS (SELECT *, CASE WHEN scan_type = 'slow' THEN 'slow_scan' WHEN port IN (137, 138) AND r < 0.4 THEN 'iot_discovery' WHEN port = 53 AND r < 0.05 AND h >= 15 THEN 'dns_resolver' WHEN port = 80 AND r < 0.1 AND h >= 15 THEN 'http_browsing' WHEN port = 1 AND r >= 0.9 THEN 'dark_traffic' WHEN r >= 0.6 THEN 'confirmed_scan' ELSE 'unknown' END AS tag FROM g),
  c AS (SELECT scan_type, src, dst, port, distinct_ports, distinct_hosts, state_ratio, tag, CASE WHEN tag IN ('dns_resolver', 'http_browsing', 'iot_discovery', 'dark_traffic') THEN 'LOW' WHEN tag = 'slow_scan' THEN CASE WHEN r >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END
    WHEN r >= 0.6 OR r >= 0.3 AND b >= 50 THEN 'HIGH' WHEN r >= 0.2 OR r >= 0.1 AND b >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM t)"""


@register("scan_classify_dedupe", with_lanes(f"{_CLASSES} SELECT * FROM c", "conn"))
def scan_classify_dedupe(spark, sf_dir):
    return ops.classify_scans(_scans(spark, sf_dir))


def _findings(spark, sf_dir):
    classed = ops.classify_scans(_scans(spark, sf_dir))
    title = F.concat_ws(" ", "scan_type", "src", F.coalesce("dst", F.lit("*")), F.coalesce(F.col("port").cast("string"), F.lit("-")))
    return ops.finding(classed, "scan", F.col("severity"), title, ["scan_type", "tag", "distinct_ports", "distinct_hosts"], description="connection attempts over ports or hosts", next_steps=["review the source's connections"], window=(0.0, 1.0))


_FOUND = _CLASSES + """, f AS (SELECT 'scan' AS detector, severity, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS severity_rank, scan_type || ' ' || src || ' ' || coalesce(dst, '*') || ' ' || coalesce(port::VARCHAR, '-') AS title, scan_type, tag, distinct_ports, distinct_hosts FROM c)"""


@register("finding_model", with_lanes(f"{_FOUND} SELECT detector, severity, severity_rank, title, tag, distinct_ports, 1 AS steps, 1.0::DOUBLE AS window_end FROM f", "conn"))
def finding_model(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    part = lambda n: F.get_json_object("evidence", f"$.{n}")
    return rows.select("detector", "severity", "severity_rank", "title", part("tag").alias("tag"), part("distinct_ports").cast("long").alias("distinct_ports"), F.size("next_steps").alias("steps"), "window_end")


@register("rank_and_cap", with_lanes(f"""{_FOUND}, o AS (SELECT *, row_number() OVER (ORDER BY scan_type <> 'vertical', severity_rank, title) AS place, count(*) OVER () AS n FROM f WHERE scan_type <> 'slow')
  SELECT title, severity, place, n - 15 AS remainder FROM o WHERE place <= 15 UNION ALL SELECT title, severity, 0, 0 FROM f WHERE scan_type = 'slow'""", "conn"))
def rank_and_cap(spark, sf_dir):
    rows = _findings(spark, sf_dir).withColumn("section", F.get_json_object("evidence", "$.scan_type"))
    return ops.rank_and_cap(rows, 15, ("vertical", "horizontal"), F.col("section") == "slow").select("title", "severity", "place", "remainder")


@register("curated_evidence", with_lanes(f"""{_FOUND} SELECT title, 'scan_type=' || scan_type || coalesce(';distinct_hosts=' || distinct_hosts, '') || CASE WHEN scan_type = 'slow' THEN ';names=a, b +1' ELSE '' END AS signals FROM f""", "conn"))
def curated_evidence(spark, sf_dir):
    rows = _findings(spark, sf_dir)
    listed = F.when(F.get_json_object("evidence", "$.scan_type") == "slow", F.regexp_replace("evidence", r"\}$", ',"names":["a","b","c"]}')).otherwise(F.col("evidence"))
    short = ops.curated(rows.withColumn("evidence", listed), {"scan": ["scan_type", "distinct_hosts", "names", "nothing"]}, 2)
    return short.select("title", F.array_join("signals", ";").alias("signals"))


@register("run_notes", with_lanes(f"""g AS (SELECT conn_state IN ('SF', 'S1') AS a, dst NOT LIKE '224.%' AS b, {_LOCAL} AS c, bytes IS NOT NULL AS d, src IS NOT NULL AND port IS NOT NULL AS e FROM rough),
  k AS (SELECT count(*) AS n0, count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3, count(*) FILTER (a AND b AND c AND d) AS n4, count(*) FILTER (a AND b AND c AND d AND e) AS n5 FROM g),
  u AS (SELECT unnest([('after_state', n0, n1), ('after_unicast', n1, n2), ('after_local', n2, n3), ('after_bytes', n3, n4), ('after_keys', n4, n5)]) AS s FROM k), v AS (SELECT s[1] AS code, s[2] AS b, s[2] - s[3] AS n FROM u)
  SELECT 'beacon' AS detector, code, n, code || ': ' || n || CASE WHEN b >= 1000 AND n >= 0.5 * b THEN ' of ' || b || ' rows left out (' || round(100.0 * n / b)::INTEGER || '%)' ELSE ' rows left out' END AS text FROM v WHERE n > 0""", "rough"))
def run_notes(spark, sf_dir):
    funnel = conn_ops.beacon_funnel(rough(spark, sf_dir))
    return ops.run_notes(funnel, "beacon", ["rows_total", "after_state", "after_unicast", "after_local", "after_bytes", "after_keys"])


@register("control_strip", r"""SELECT doc_id, length(regexp_replace(text || chr(7), '[\x00-\x1F\x7F-\x9F]', '', 'g')) AS bare, length(regexp_replace(text || chr(7), '[\x00-\x09\x0B-\x1F\x7F-\x9F]', '', 'g')) AS lines,
  coalesce(nullif(trim(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(9) ELSE source || chr(10) END, '[\x00-\x1F\x7F-\x9F]', '', 'g')), ''), '(unknown)') AS label FROM documents""")
def control_strip(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    said, name = F.concat("text", F.lit("\x07")), F.when(F.col("doc_id") % 5 == 0, F.lit(" \t")).otherwise(F.concat("source", F.lit("\n")))
    return rows.select("doc_id", F.length(text.strip_control(said)).alias("bare"), F.length(text.strip_control(said, True)).alias("lines"), text.clean_label(name).alias("label"))


@register("format_helpers", """WITH o AS (SELECT o_orderkey AS k, o_orderkey::BIGINT * o_orderkey AS n, o_orderkey * 7 AS s FROM orders)
  SELECT k, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KiB', round(n / 1024.0::DOUBLE, 1)) WHEN n < 1073741824 THEN format('{:.1f} MiB', round(n / 1048576.0::DOUBLE, 1)) WHEN n < 1099511627776 THEN format('{:.1f} GiB', round(n / 1073741824.0::DOUBLE, 1)) ELSE format('{:.1f} TiB', round(n / 1099511627776.0::DOUBLE, 1)) END AS size,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' END AS span,
  CASE WHEN k > 500 THEN '>50x' ELSE format('{:.1f}x', k / 10.0::DOUBLE) END AS ratio FROM o""")
def format_helpers(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    return read(spark, sf_dir, "orders").select(k.alias("k"), text.human_bytes(k * k).alias("size"), text.compact_span(k * 7).alias("span"), text.ratio_cell(k / 10.0).alias("ratio"))


@register("event_time_evidence", with_lanes("""f AS (SELECT src, min(ts) AS a, CASE WHEN src LIKE '%7' THEN NULL ELSE max(ts) END AS b FROM conn GROUP BY src)
  SELECT src, CASE WHEN b IS NOT NULL THEN strftime(to_timestamp(floor(a)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS first_seen, CASE WHEN b IS NOT NULL THEN strftime(to_timestamp(floor(b)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS last_seen, b - a AS span_seconds FROM f""", "conn"))
def event_time_evidence(spark, sf_dir):
    bounds = conn(spark, sf_dir).groupBy("src").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).withColumn("b", F.when(~F.col("src").endswith("7"), F.col("b")))
    return bounds.withColumn("e", text.time_evidence(F.col("a"), F.col("b"))).select("src", "e.first_seen", "e.last_seen", "e.span_seconds")
