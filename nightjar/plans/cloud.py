"""Registered cloud-audit and authentication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import auth, cloud
from nightjar.plans.projections import cloudtrail, decisions, with_lanes
from nightjar.registry import register

_PROFILE = """b AS (SELECT principal, count(*) AS events, avg((error_code IS NOT NULL)::INTEGER) AS error_rate, count(DISTINCT source_ip) AS ips, count(DISTINCT event_name) AS names, count(DISTINCT event_source) AS services,
  count(DISTINCT aws_region) AS regions, avg((read_write = 'read')::INTEGER) AS read_ratio, count(DISTINCT floor(ts / 3600) % 24) AS hours FROM cloudtrail GROUP BY principal),
n AS (SELECT principal, event_name, count(*) AS n FROM cloudtrail GROUP BY ALL), p AS (SELECT principal, n / sum(n) OVER (PARTITION BY principal)::DOUBLE AS p FROM n),
h AS (SELECT principal, -sum(p * log2(p)) AS action_entropy FROM p GROUP BY principal)"""


@register("aws_lane_filter", with_lanes("SELECT sum(n)::BIGINT AS interactive_rows, count(*) FILTER (n < 20) AS below_floor FROM (SELECT principal, count(*) AS n FROM cloudtrail WHERE lane = 'interactive' GROUP BY principal)", "cloudtrail"))
def aws_lane_filter(spark, sf_dir):
    return cloud.lane_facts(cloudtrail(spark, sf_dir))


@register("principal_profile", with_lanes(f"{_PROFILE} SELECT principal, events, round_even(error_rate, 6) AS error_rate, ips, names, services, regions, round_even(read_ratio, 6) AS read_ratio, hours, round_even(action_entropy, 6) AS action_entropy FROM b JOIN h USING (principal)", "cloudtrail"))
def principal_profile(spark, sf_dir):
    return cloud.principal_profile(cloudtrail(spark, sf_dir)).withColumns({c: F.bround(c, 6) for c in ("error_rate", "read_ratio", "action_entropy")})


@register("action_rarity", with_lanes("SELECT event_name, count(*) AS events, round_even(log10(sum(count(*)) OVER ()) - log10(count(*)), 6) AS rarity FROM cloudtrail GROUP BY event_name", "cloudtrail"))
def action_rarity(spark, sf_dir):
    return cloud.action_rarity(cloudtrail(spark, sf_dir)).withColumn("rarity", F.bround("rarity", 6))


_Z = " + ".join(f"CASE WHEN stddev_pop({p}) OVER () > 1e-12 THEN ({p} - avg({p}) OVER ()) / stddev_pop({p}) OVER () ELSE 0 END" for p in ("error_rate", "ln(1 + ips)", "ln(1 + names)", "action_entropy"))


@register("principal_composite", with_lanes(f"""{_PROFILE}, j AS (SELECT * FROM b JOIN h USING (principal) WHERE events >= 20), z AS (SELECT principal, events, {_Z} AS z FROM j WHERE (SELECT count(*) FROM j) >= 5)
  SELECT principal, events, round_even(z, 4) AS composite, CASE WHEN z >= 2 THEN 'HIGH' WHEN z >= 1 THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM z""", "cloudtrail"))
def principal_composite(spark, sf_dir):
    return cloud.principal_composite(cloudtrail(spark, sf_dir))


_FIRST = """f AS (SELECT *, row_number() OVER (PARTITION BY principal, event_name ORDER BY ts, row_id) AS a, row_number() OVER (PARTITION BY principal ORDER BY ts, row_id) AS b FROM cloudtrail), s AS (SELECT * FROM f WHERE a = 1 AND b > 1)"""


@register("first_seen_actions", with_lanes(f"{_FIRST} SELECT row_id, principal, event_name, ts FROM s", "cloudtrail"))
def first_seen_actions(spark, sf_dir):
    return cloud.first_seen_actions(cloudtrail(spark, sf_dir)).select("row_id", "principal", "event_name", "ts")


@register("action_bursts", with_lanes(f"""{_FIRST}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < 7200 THEN 0 ELSE 1 END AS o FROM s WINDOW w AS (PARTITION BY principal ORDER BY ts, row_id)), i AS (SELECT *, sum(o) OVER (PARTITION BY principal ORDER BY ts, row_id) AS burst FROM g),
  r AS (SELECT principal, burst, count(*) AS actions, min(ts) AS first_ts, max(ts) AS last_ts, avg((error_code IS NOT NULL)::INTEGER) AS error_ratio, count(DISTINCT event_source) AS services, string_agg(event_name, ',' ORDER BY ts, row_id) AS names FROM i GROUP BY ALL HAVING count(*) >= 3)
  SELECT principal, actions, first_ts, last_ts, error_ratio, services, names, CASE WHEN error_ratio >= 0.5 OR (services >= 3 AND first_ts - (SELECT min(ts) FROM cloudtrail) >= 3600) THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM r""", "cloudtrail"))
def action_bursts(spark, sf_dir):
    return cloud.action_bursts(cloudtrail(spark, sf_dir), gap=7200.0)


_DENIED = "d AS (SELECT * FROM decisions WHERE outcome = 'denied')"
_CONC = f"{_DENIED}, c AS (SELECT host, gate, source, actor, count(*) AS denials, min(ts) AS first_ts, max(ts) AS last_ts FROM d GROUP BY host, gate, source, actor)"


@register("auth_concentration", with_lanes(f"{_CONC} SELECT * FROM c WHERE denials >= 10", "decisions"))
def auth_concentration(spark, sf_dir):
    return auth.concentration(decisions(spark, sf_dir), 10)


@register("auth_concentration_near_miss", with_lanes(f"{_CONC} SELECT count(*) AS keys, count(*) FILTER (denials >= 10) AS firing, max(denials) FILTER (denials < 10) AS near_miss FROM c", "decisions"))
def auth_concentration_near_miss(spark, sf_dir):
    return auth.concentration_near_miss(decisions(spark, sf_dir), 10)


@register("auth_fanout", with_lanes(f"{_DENIED} SELECT 'source' AS kind, source AS identity, count(DISTINCT actor) AS breadth, count(*) AS denials FROM d GROUP BY source HAVING count(DISTINCT actor) >= 5 UNION ALL SELECT 'account', 'unix_user:' || actor, count(DISTINCT source), count(*) FROM d GROUP BY actor HAVING count(DISTINCT source) >= 5", "decisions"))
def auth_fanout(spark, sf_dir):
    return auth.fanout(decisions(spark, sf_dir))


@register("auth_volume", with_lanes(f"""{_CONC}, e AS (SELECT 'source' AS kind, source AS identity, count(*) AS denials FROM d GROUP BY source UNION ALL SELECT 'account', actor, count(*) FROM d GROUP BY actor)
  SELECT kind, identity, denials FROM e WHERE denials >= greatest(18, ceil(18 * (SELECT greatest(1, (max(ts) - min(ts)) / 86400) FROM decisions)))
  AND NOT EXISTS (SELECT 1 FROM c WHERE denials >= 24 AND ((kind = 'source' AND source = identity) OR (kind = 'account' AND actor = identity)))""", "decisions"))
def auth_volume(spark, sf_dir):
    return auth.volume(decisions(spark, sf_dir), covered_least=24)


@register("auth_host_spread", with_lanes(f"{_DENIED} SELECT source, actor_namespace, actor, count(DISTINCT lower(host)) AS hosts, count(*) AS denials FROM d GROUP BY ALL HAVING count(DISTINCT lower(host)) >= 3", "decisions"))
def auth_host_spread(spark, sf_dir):
    return auth.host_spread(decisions(spark, sf_dir))


@register("landing_runs", with_lanes("""b AS (SELECT host, gate, source, actor, ts, count(*) FILTER (outcome = 'denied') AS denied, count(*) FILTER (outcome = 'granted') AS granted FROM decisions GROUP BY ALL),
  i AS (SELECT *, coalesce(sum((granted > 0)::INTEGER) OVER (PARTITION BY host, gate, source, actor ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM b),
  r AS (SELECT host, gate, source, actor, island, sum(denied)::BIGINT AS denials, max(ts) FILTER (granted > 0) AS granted_ts, max(granted > 0 AND denied > 0) AS tie, min(ts) AS first_ts FROM i GROUP BY ALL),
  l AS (SELECT host, gate, source, actor, max(ts) AS last_denied FROM decisions WHERE outcome = 'denied' GROUP BY ALL)
  SELECT host, gate, source, actor, denials, first_ts, granted_ts, CASE WHEN tie THEN 'tie-unresolved' WHEN last_denied > granted_ts THEN 'resumed' ELSE 'ceased' END AS state,
  left(sha256(host || '|' || gate || '|' || source || '|' || actor || '|' || island), 20) AS id FROM r LEFT JOIN l USING (host, gate, source, actor) WHERE denials >= 3 AND granted_ts IS NOT NULL""", "decisions"))
def landing_runs(spark, sf_dir):
    return auth.landing_runs(decisions(spark, sf_dir), 3)


@register("auth_firing_facts", with_lanes(f"""{_CONC}, k AS (SELECT host, gate, source, actor FROM c WHERE denials >= 10), v AS (SELECT DISTINCT actor FROM decisions WHERE outcome = 'granted')
  SELECT host, gate, source, actor, count(*) AS records, count(*) FILTER (outcome = 'denied') AS denials, count(DISTINCT actor) AS accounts, count(DISTINCT actor) FILTER (actor IN (SELECT actor FROM v)) AS live_accounts, count(DISTINCT host) AS hosts, min(ts) AS first_ts, max(ts) AS last_ts
  FROM decisions JOIN k USING (host, gate, source, actor) GROUP BY ALL""", "decisions"))
def auth_firing_facts(spark, sf_dir):
    lane = decisions(spark, sf_dir)
    return auth.firing_facts(lane, auth.concentration(lane, 10), auth.KEY)
