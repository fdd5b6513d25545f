"""Registered suppression, window, profile and card queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import digest, lists, names
from nightjar.plans.projections import cloudtrail, conn, dns, domains_sql, pihole, read, syslog, with_lanes
from nightjar.registry import register

DOMAINS = ("*.d3.lan", "re:^www\\.d[0-2]", "d7.*", "re:(")
_DOMAIN_HIT = "regexp_matches(lower(query), '(^.*\\.d3\\.lan$)|(^www\\.d[0-2])|(^d7\\..*$)') OR regexp_matches('x.' || lower(query), '(^.*\\.d3\\.lan$)|(^www\\.d[0-2])|(^d7\\..*$)')"


@register("suppress_domains", with_lanes(f"SELECT row_id, query FROM dns WHERE NOT ({_DOMAIN_HIT})", "dns"))
def suppress_domains(spark, sf_dir):
    return lists.suppress(dns(spark, sf_dir), "query", DOMAINS).select("row_id", "query")


@register("suppress_hosts", with_lanes("SELECT row_id, host FROM syslog WHERE NOT regexp_matches(host, '^h[13]$')", "syslog"))
def suppress_hosts(spark, sf_dir):
    return lists.suppress(syslog(spark, sf_dir), "host", ("h1", "re:^h3$"), apex=False).select("row_id", "host")


@register("cross_feed_arbitrate", with_lanes("SELECT row_id, host FROM syslog WHERE host NOT IN (SELECT DISTINCT host FROM syslog WHERE program = 'error' AND message LIKE '%7')", "syslog"))
def cross_feed_arbitrate(spark, sf_dir):
    lane = syslog(spark, sf_dir)
    return lists.arbitrate(lane.filter("program = 'error' AND message LIKE '%7'").withColumn("host", F.upper("host")), lane).select("row_id", "host")


@register("default_window", with_lanes("SELECT row_id, ts FROM conn WHERE ts >= (SELECT max(ts) FROM conn) - 604800", "conn"))
def default_window(spark, sf_dir):
    return lists.trailing_window(conn(spark, sf_dir), 604_800.0).select("row_id", "ts")


@register("dual_window", with_lanes("SELECT row_id, ts BETWEEN 1705000000 AND 1706000000 AS in_report, ts >= 1704000000 AND ts < 1705000000 AS in_context FROM pihole", "pihole"))
def dual_window(spark, sf_dir):
    return lists.dual_window(pihole(spark, sf_dir), 1_705_000_000.0, 1_706_000_000.0, 1_000_000.0).select("row_id", "in_report", "in_context")


@register("lane_summary", with_lanes("SELECT 'conn' AS lane, count(*) AS rows, count(ts) AS timed, min(ts) AS first_ts, max(ts) AS last_ts FROM conn UNION ALL SELECT 'dns', count(*), count(ts), min(ts), max(ts) FROM dns UNION ALL SELECT 'syslog', count(*), count(ts), min(ts), max(ts) FROM syslog", "conn", "dns", "syslog"))
def lane_summary(spark, sf_dir):
    return lists.lane_summary({"conn": conn(spark, sf_dir), "dns": dns(spark, sf_dir), "syslog": syslog(spark, sf_dir)})


@register("text_profile", """WITH l AS (SELECT source AS file, unnest(string_split(text, chr(10))) AS value FROM documents WHERE text IS NOT NULL), t AS (SELECT file, unnest(string_split(value, ' ')) AS token FROM l), c AS (SELECT file, token, count(*) AS n FROM t WHERE token <> '' GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, encode(token)) AS r FROM c), m AS (SELECT file, string_agg(token || ':' || n, ',' ORDER BY r) AS top_tokens FROM r WHERE r <= 3 GROUP BY file)
  SELECT file, count(*) AS lines, round_even(avg(length(value)), 4) AS mean_length, quantile_cont(length(value), 0.5) AS median_length, quantile_cont(length(value), 0.95) AS p95_length, round_even(stddev_pop(length(value)), 4) AS stddev_length,
  round_even(sum(length(regexp_replace(value, '[^\\x20-\\x7E]', '', 'g'))) / greatest(sum(length(value)), 1)::DOUBLE, 4) AS printable, round_even(avg(regexp_matches(value, '^\\s*\\{.*\\}\\s*$')::INTEGER), 4) AS json_share, any_value(top_tokens) AS top_tokens FROM l LEFT JOIN m USING (file) GROUP BY file""")
def text_profile(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("source").alias("file"), F.explode(F.split("text", "\n")).alias("value"))
    return lists.text_profile(lines)


def _dist(slot: str, rows: str, entity: str) -> str:
    return f"SELECT * FROM (SELECT '{slot}' AS slot, 'dist' AS statistic, {entity} AS entity, count(*)::DOUBLE AS magnitude, round_even(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS ratio FROM {rows} WHERE {entity} IS NOT NULL GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 3)"


def _rate(slot: str, rows: str, kind: str, owner: str) -> str:
    return f"SELECT '{slot}', 'rate', (SELECT {owner} FROM {rows} WHERE {kind} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), count(*) FILTER ({kind})::DOUBLE, round_even(count(*) FILTER ({kind}) / count(*)::DOUBLE, 4) FROM {rows} HAVING count(*) FILTER ({kind}) >= 5 AND count(*) FILTER ({kind}) >= 0.01 * count(*)"


@register("digest_dns", with_lanes(f"{_dist('clients', 'dns', 'src')} UNION ALL {_dist('qtypes', 'dns', 'qtype::VARCHAR')} UNION ALL {_rate('nxdomain', 'dns', 'rcode = 3', 'src')}", "dns"))
def digest_dns(spark, sf_dir):
    rows = dns(spark, sf_dir)
    return digest.dist(rows, "clients", F.col("src")).unionByName(digest.dist(rows, "qtypes", F.col("qtype").cast("string"))).unionByName(digest.rate(rows, "nxdomain", F.col("rcode") == 3, F.col("src")))


@register("digest_syslog", with_lanes(f"{_dist('hosts', 'syslog', 'host')} UNION ALL {_dist('programs', 'syslog', 'program')} UNION ALL {_rate('errors', 'syslog', "regexp_matches(message, '(?i)\\b(error|fail|denied)')", 'host')}", "syslog"))
def digest_syslog(spark, sf_dir):
    rows = syslog(spark, sf_dir)
    bad = F.col("message").rlike(r"(?i)\b(error|fail|denied)")
    return digest.dist(rows, "hosts", F.col("host")).unionByName(digest.dist(rows, "programs", F.col("program"))).unionByName(digest.rate(rows, "errors", bad, F.col("host")))


@register("digest_cloudtrail", with_lanes(f"{_dist('lanes', 'cloudtrail', 'lane')} UNION ALL {_dist('principals', 'cloudtrail', 'principal')} UNION ALL {_dist('services', 'cloudtrail', 'event_source')} UNION ALL {_dist('regions', 'cloudtrail', 'aws_region')} UNION ALL {_rate('errors', 'cloudtrail', 'error_code IS NOT NULL', 'principal')}", "cloudtrail"))
def digest_cloudtrail(spark, sf_dir):
    rows = cloudtrail(spark, sf_dir)
    out = digest.rate(rows, "errors", F.col("error_code").isNotNull(), F.col("principal"))
    for slot, column in (("lanes", "lane"), ("principals", "principal"), ("services", "event_source"), ("regions", "aws_region")):
        out = out.unionByName(digest.dist(rows, slot, F.col(column)))
    return out


@register("query_shape", with_lanes(f"""{domains_sql('dns', 'query')} SELECT name AS query, length(array_to_string(l, '.')) AS length, len(l) AS parts, length(domain) AS domain_length,
  length(l[len(l)]) AS suffix_len, CASE WHEN len(l) > 1 THEN length(l[len(l) - 1]) ELSE 0 END AS second_len, l[len(l)] AS suffix FROM domains""", "dns"))
def query_shape(spark, sf_dir):
    return names.query_shapes(dns(spark, sf_dir))
