"""Registered flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import conn as ops
from nightjar.plans.projections import beacons, conn, rough, with_lanes
from nightjar.registry import register

RULES = (ops.FlowRule("10.0.0.1", "203.0.113.0/28"), ops.FlowRule("2001:db8:1::/48", "2001:db8:9::1"), ops.FlowRule("10.0.0.0/29", "*", 53, "udp"), ops.FlowRule("10.0.0.3", port=9, detectors=("another",)))

#: An IPv4 address, also in IPv6 form, as a number; null for all else
_NUM = lambda c: f"CASE WHEN regexp_matches({c}, '^(::ffff:)?[0-9]+[.]') THEN list_reduce(list_transform(string_split(replace({c}, '::ffff:', ''), '.'), lambda x: x::BIGINT), lambda a, x: a * 256 + x) END"
_HIT = f"""((src = '10.0.0.1' AND coalesce({_NUM('dst')} BETWEEN 3405803776 AND 3405803791, false)) OR (dst = '10.0.0.1' AND coalesce({_NUM('src')} BETWEEN 3405803776 AND 3405803791, false))
  OR (src = '2001:db8:9::1' AND dst LIKE '2001:db8:1::%') OR ((coalesce({_NUM('src')} BETWEEN 167772160 AND 167772167, false) OR coalesce({_NUM('dst')} BETWEEN 167772160 AND 167772167, false)) AND port = 53 AND proto = 'udp'))"""
_KEPT = f"kept AS (SELECT * FROM rough WHERE NOT coalesce({_HIT}, false))"
_LOCAL = "coalesce(local_orig, src LIKE '10.%' OR src LIKE '::ffff:10.%', false)"
_PARSED = "src IS NOT NULL AND dst <> 'nowhere'"
_EXTERNAL = "(dst LIKE '203.%' OR dst LIKE '2001:%')"
_ELIGIBLE = f"ok AS (SELECT * FROM kept WHERE {_PARSED} AND {_LOCAL} AND {_EXTERNAL} AND bytes >= 0 AND resp_bytes >= 0)"


def _kept(spark, sf_dir):
    return ops.suppress_flows(rough(spark, sf_dir), RULES)


@register("suppress_flows", with_lanes(f"{_KEPT} SELECT row_id, src, dst, port, proto FROM kept", "rough"))
def suppress_flows(spark, sf_dir):
    return _kept(spark, sf_dir).select("row_id", "src", "dst", "port", "proto")


@register("suppression_counts", with_lanes(f"SELECT count(*) AS rows, count(DISTINCT src) AS sources FROM rough WHERE {_HIT}", "rough"))
def suppression_counts(spark, sf_dir):
    return ops.suppression_counts(rough(spark, sf_dir), RULES)


@register("effective_local", with_lanes(f"SELECT row_id, {_LOCAL} AS effective_local, {_EXTERNAL} AS dst_external FROM rough", "rough"))
def effective_local(spark, sf_dir):
    return ops.effective_local(rough(spark, sf_dir)).select("row_id", "effective_local", F.col("dst_facts.external").alias("dst_external"))


@register("beacon_eligibility", with_lanes(f"""g AS (SELECT conn_state IN ('SF', 'S1') AS a, dst NOT LIKE '224.%' AS b, {_LOCAL} AS c, bytes IS NOT NULL AS d, src IS NOT NULL AND port IS NOT NULL AS e FROM rough)
  SELECT count(*) AS rows_total, count(*) FILTER (a) AS after_state, count(*) FILTER (a AND b) AS after_unicast, count(*) FILTER (a AND b AND c) AS after_local, count(*) FILTER (a AND b AND c AND d) AS after_bytes, count(*) FILTER (a AND b AND c AND d AND e) AS after_keys FROM g""", "rough"))
def beacon_eligibility(spark, sf_dir):
    return ops.beacon_funnel(rough(spark, sf_dir))


@register("flow_group", with_lanes("SELECT src, dst, port, proto, count(*) AS connections, min(ts) AS first_ts, max(ts) AS last_ts, avg(bytes) AS mean_bytes FROM conn GROUP BY ALL HAVING count(*) >= 2", "conn"))
def flow_group(spark, sf_dir):
    return ops.flow_group(conn(spark, sf_dir), floor=2)


@register("beacon_score")
def beacon_score(spark, sf_dir):
    return ops.beacon_score(ops.beacon_eligible(beacons(spark, sf_dir)), floor=10)


@register("exfil_funnel", with_lanes(f"""g AS (SELECT {_PARSED} AS a, {_LOCAL} AS b, {_EXTERNAL} AS c, bytes >= 0 AND resp_bytes >= 0 AS d FROM rough)
  SELECT count(*) AS rows_total, count(*) FILTER (a) AS after_parse, count(*) FILTER (a AND b) AS after_local, count(*) FILTER (a AND b AND c) AS after_external, count(*) FILTER (a AND b AND c AND d) AS after_bytes FROM g""", "rough"))
def exfil_funnel(spark, sf_dir):
    return ops.exfil_funnel(rough(spark, sf_dir))


_PAIRS = """pairs AS (SELECT src, dst, sum(bytes)::BIGINT AS orig_bytes, sum(resp_bytes)::BIGINT AS resp_bytes, count(*) AS connections, min(ts) AS first_ts, max(ts) AS last_ts, max(duration) AS max_duration,
  round_even(sum(bytes) / (sum(bytes) + sum(resp_bytes))::DOUBLE, 4) AS orig_share FROM ok GROUP BY src, dst HAVING sum(bytes) >= 200000 AND sum(bytes) / (sum(bytes) + sum(resp_bytes))::DOUBLE >= 0.6)"""
_EXFIL = f"""{_KEPT}, {_ELIGIBLE}, {_PAIRS},
svc AS (SELECT src, dst, coalesce(port::VARCHAR, '?') || '/' || coalesce(proto, '?') AS service, sum(bytes + resp_bytes)::BIGINT AS n FROM ok GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, service) AS r FROM svc),
mixed AS (SELECT src, dst, string_agg(service || ':' || n, ',' ORDER BY r) AS service_mix FROM top WHERE r <= 3 GROUP BY src, dst)"""


@register("exfil_pairs", with_lanes(f"{_EXFIL} SELECT * FROM pairs LEFT JOIN mixed USING (src, dst)", "rough"))
def exfil_pairs(spark, sf_dir):
    return ops.exfil_pairs(_kept(spark, sf_dir), min_bytes=200_000)


@register("exfil_pool_rollup", with_lanes(f"""{_KEPT}, {_ELIGIBLE}, {_PAIRS},
  n AS (SELECT *, CASE WHEN dst LIKE '203.%' THEN '203.0.112.0/20' ELSE '2001:0db8:0000:0000:0000:0000:0000:0000/40' END AS net FROM pairs),
  pool AS (SELECT src, net, count(*) AS destinations, sum(orig_bytes)::BIGINT AS orig_bytes, sum(resp_bytes)::BIGINT AS resp_bytes, sum(connections)::BIGINT AS connections, min(first_ts) AS first_ts, max(last_ts) AS last_ts, string_agg(dst, ',' ORDER BY dst) AS members FROM n GROUP BY src, net HAVING count(*) >= 4)
  SELECT src, net AS target, 'destination_pool' AS tier, destinations, orig_bytes, resp_bytes, connections, first_ts, last_ts, members FROM pool
  UNION ALL SELECT src, dst, 'pair', 1, orig_bytes, resp_bytes, connections, first_ts, last_ts, dst FROM n WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.src = n.src AND p.net = n.net)""", "rough"))
def exfil_pool_rollup(spark, sf_dir):
    return ops.exfil_pools(ops.exfil_pairs(_kept(spark, sf_dir), min_bytes=200_000, services=False))


@register("exfil_partial_facts", with_lanes(f"""p AS (SELECT src, dst, count(*) FILTER (resp_bytes >= 0) AS complete_rows, count(*) FILTER (resp_bytes IS NULL) AS excluded_rows, coalesce(sum(bytes) FILTER (resp_bytes >= 0), 0)::BIGINT AS eligible_bytes,
  coalesce(sum(bytes) FILTER (resp_bytes IS NULL), 0)::BIGINT AS excluded_bytes, coalesce(sum(resp_bytes), 0)::BIGINT AS resp_bytes FROM rough WHERE {_PARSED} AND {_LOCAL} AND {_EXTERNAL} AND bytes >= 0 GROUP BY src, dst HAVING count(*) FILTER (resp_bytes IS NULL) > 0)
  SELECT *, eligible_bytes + excluded_bytes >= 200000 AND (eligible_bytes + excluded_bytes) / (eligible_bytes + excluded_bytes + resp_bytes)::DOUBLE >= 0.6 AS could_surface FROM p""", "rough"))
def exfil_partial_facts(spark, sf_dir):
    return ops.exfil_partial_facts(rough(spark, sf_dir), min_bytes=200_000)


_SCAN = "s AS (SELECT *, conn_state IN ('S0', 'REJ', 'RSTO', 'RSTR', 'SH', 'OTH') AS is_scan FROM conn)"


def _widest(keys: str, value: str, name: str, least: int, span: float) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{_SCAN}, c AS (SELECT {keys}, avg(is_scan::INTEGER) AS r, count(*) AS connections FROM s GROUP BY {keys} HAVING count(DISTINCT {value}) >= {least}),
    k AS (SELECT s.* FROM s JOIN c USING ({keys})), w AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.row_id, count(DISTINCT b.{value}) AS n FROM k a JOIN k b ON {on} AND b.ts BETWEEN a.ts - {span} AND a.ts GROUP BY ALL)
    SELECT {keys}, max(n) AS {name}, round_even(any_value(r), 3) AS state_ratio, any_value(connections) AS connections FROM w JOIN c USING ({keys}) GROUP BY {keys} HAVING max(n) >= {least}"""


@register("scan_vertical", with_lanes(_widest("src, dst", "port", "distinct_ports", 3, 86400.0), "conn"))
def scan_vertical(spark, sf_dir):
    return ops.scan_vertical(conn(spark, sf_dir), span=86_400.0, least=3)


@register("scan_horizontal", with_lanes(_widest("src, port", "dst", "distinct_hosts", 2, 864000.0), "conn"))
def scan_horizontal(spark, sf_dir):
    return ops.scan_horizontal(conn(spark, sf_dir), span=864_000.0, least=2)


@register("scan_block", with_lanes(f"""{_SCAN}, b AS (SELECT *, floor(ts / 86400)::BIGINT AS bucket FROM s), g AS (SELECT src FROM b GROUP BY src HAVING count(DISTINCT port) >= 5 AND count(DISTINCT dst) >= 5 AND avg(is_scan::INTEGER) >= 0.3),
  e AS (SELECT src, bucket, count(DISTINCT port) AS distinct_ports, count(DISTINCT dst) AS distinct_hosts, count(*) AS connections, avg(is_scan::INTEGER) AS r, min(ts) AS first_ts, count(*) FILTER (port <= 1023) AS well_known FROM b JOIN g USING (src) GROUP BY src, bucket),
  f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distinct_ports * distinct_hosts DESC, bucket) AS n FROM e WHERE distinct_ports >= 5 AND distinct_hosts >= 5 AND r >= 0.3)
  SELECT src, bucket, distinct_ports, distinct_hosts, connections, first_ts, well_known, round_even(r, 3) AS state_ratio FROM f WHERE n = 1""", "conn"))
def scan_block(spark, sf_dir):
    return ops.scan_block(conn(spark, sf_dir), span=86_400.0, ports=5, hosts=5)


@register("scan_slow", with_lanes(f"""{_SCAN}, b AS (SELECT *, floor(ts / 3600)::BIGINT AS bucket FROM s), e AS (SELECT src, bucket, count(DISTINCT port) AS ports FROM b GROUP BY ALL),
  x AS (SELECT src, count(*) AS active_buckets, max(ports) AS most_in_bucket FROM e GROUP BY src), w AS (SELECT src, count(DISTINCT port) AS distinct_ports, count(DISTINCT dst) AS distinct_hosts, avg(is_scan::INTEGER) AS r, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY src),
  p AS (SELECT src, port, count(*) AS n FROM b GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, port) AS k FROM p), m AS (SELECT src, string_agg(port || ':' || n, ',' ORDER BY k) AS top_ports FROM q WHERE k <= 3 GROUP BY src)
  SELECT src, distinct_ports, distinct_hosts, first_ts, last_ts, active_buckets, most_in_bucket, top_ports, round_even(r, 3) AS state_ratio FROM w JOIN x USING (src) JOIN m USING (src) WHERE active_buckets >= 4 AND distinct_ports >= 8 AND most_in_bucket < 15 AND r >= 0.3""", "conn"))
def scan_slow(spark, sf_dir):
    return ops.scan_slow(conn(spark, sf_dir))
