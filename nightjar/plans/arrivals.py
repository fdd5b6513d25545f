"""Registered queries on blocked names that are new to an address."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import arrivals, names
from nightjar.plans.projections import domains_sql, pihole, with_lanes
from nightjar.registry import register

END, REPORT = 1_706_600_000.0, 14


def _lane(spark, sf_dir):
    """The resolver lane with a name of its own for most rows, so that some are new; a few addresses and names can't be used."""
    rows = pihole(spark, sf_dir)
    name = F.expr("case when row_id % 41 = 0 then 'single' when row_id % 43 = 0 then 'con\\u0001trol.com' when row_id % 5 = 0 then concat('H', row_id % 400, '.', query, '.') else query end")
    kind = F.expr("case when event_type in ('forwarded', 'cached') and row_id % 6 <> 0 then 'gravity_blocked' else event_type end")
    return rows.withColumns({"query": name, "event_type": kind, "src": F.expr("case when src is null then null when row_id % 37 = 0 then 'host' when row_id % 13 = 0 then '::ffff:' || src else src end")})


_ROWS = """z AS (SELECT row_id, ts, CASE WHEN row_id % 41 = 0 THEN 'single' WHEN row_id % 43 = 0 THEN 'con' || chr(1) || 'trol.com' WHEN row_id % 5 = 0 THEN 'H' || (row_id % 400) || '.' || query || '.' ELSE query END AS query,
  CASE WHEN event_type IN ('forwarded', 'cached') AND row_id % 6 <> 0 THEN 'gravity_blocked' ELSE event_type END AS event_type, CASE WHEN src IS NULL THEN NULL WHEN row_id % 37 = 0 THEN 'host' WHEN row_id % 13 = 0 THEN '::ffff:' || src ELSE src END AS src FROM pihole),
  n AS (SELECT *, regexp_replace(lower(query), '[.]+$', '') AS name, replace(src, '::ffff:', '') AS address,
    CASE WHEN query LIKE 'con%' THEN 'control_in_name' WHEN query = 'single' THEN 'invalid_name' WHEN src IS NULL OR src = 'host' THEN 'invalid_address' END AS reason FROM z)"""


@register("dnsblock_normalise", with_lanes(f"{_ROWS} SELECT row_id, name, CASE WHEN src IS NULL OR src = 'host' THEN NULL ELSE address END AS address, reason FROM n", "pihole"))
def dnsblock_normalise(spark, sf_dir):
    return arrivals.normalised(_lane(spark, sf_dir)).select("row_id", "name", "address", "reason")


_NAMES = f"""{_ROWS}, pr AS (SELECT address, name, floor(({END} - ts) / 86400)::BIGINT AS period, count(*) AS rows, min(ts) AS first_ts FROM n WHERE event_type = 'query' AND reason IS NULL AND ts <= {END} GROUP BY ALL),
  dy AS (SELECT DISTINCT name, floor(ts / 86400)::BIGINT AS day, event_type = 'gravity_blocked' AS blocked FROM n WHERE event_type IN ('gravity_blocked', 'forwarded', 'cached') AND ts <= {END}),
  fc AS (SELECT name, min(day) FILTER (blocked) AS block_day, min(day) FILTER (NOT blocked) AS handled FROM dy GROUP BY name),
  us AS (SELECT address, name, min(first_ts) AS asked, min(period) AS period, arg_min(first_ts, period) AS first_ts, sum(rows)::BIGINT AS rows FROM pr GROUP BY ALL), {domains_sql('us', 'name')},
  rt AS (SELECT address, us.name, domain AS family, period, first_ts, rows, CASE WHEN handled < block_day THEN 'prior_handling' WHEN EXISTS (SELECT 1 FROM dy WHERE dy.name = us.name AND NOT blocked AND day = block_day) THEN 'same_day_ambiguous'
    WHEN asked < first_ts THEN 'prior_address_query' ELSE 'qualifying' END AS route FROM us JOIN fc USING (name) JOIN domains USING (name) WHERE period < {REPORT} AND block_day IS NOT NULL)"""
_ROUTES = f"""{_NAMES}, gp AS (SELECT address, family, count(*) FILTER (route = 'qualifying') AS names, max(period) FILTER (route = 'qualifying') AS period, (sum(rows) FILTER (route = 'qualifying'))::BIGINT AS rows, min(first_ts) FILTER (route = 'qualifying') AS first_ts FROM rt GROUP BY ALL),
  ac AS (SELECT rt.address, rt.family, count(DISTINCT pr.period) AS active FROM rt JOIN pr USING (address, name) WHERE route = 'qualifying' AND pr.period < {REPORT} GROUP BY ALL),
  ad AS (SELECT address, max(period) AS oldest FROM pr GROUP BY 1),
  er AS (SELECT gp.*, coalesce(active, 0) AS active, CASE WHEN names = 0 THEN 'no_qualifying_name' WHEN (SELECT count(DISTINCT period) FROM pr WHERE pr.period > gp.period) < {{history}} THEN 'insufficient_history' WHEN NOT coalesce(oldest > gp.period, false) THEN 'no_prior_address_activity' WHEN coalesce(active, 0) < {{active}} THEN 'insufficient_active_periods' END AS early
    FROM gp LEFT JOIN ac USING (address, family) LEFT JOIN ad USING (address)),
  routes AS (SELECT address, family, coalesce(early, CASE WHEN count(*) FILTER (early IS NULL) OVER (PARTITION BY family, period) >= 3 THEN 'sync_withheld' ELSE 'qualifying' END) AS route, names, period, active, rows, first_ts FROM er)"""


def _routed(spark, sf_dir, history=5, active=1):
    pairs, days = arrivals.cells(_lane(spark, sf_dir), END)
    named = arrivals.name_routes(pairs, days, REPORT)
    return named, pairs, arrivals.pair_routes(named, pairs, REPORT, history, active)


@register("arrival_names", with_lanes(f"{_NAMES} SELECT * FROM rt", "pihole"))
def arrival_names(spark, sf_dir):
    return _routed(spark, sf_dir)[0]


@register("arrival_route", with_lanes(_ROUTES.format(history=5, active=1) + " SELECT * FROM routes", "pihole"))
def arrival_route(spark, sf_dir):
    return _routed(spark, sf_dir)[2]


@register("arrival_fold", with_lanes(_ROUTES.format(history=5, active=1) + """, q AS (SELECT *, count(*) OVER (PARTITION BY address) AS n FROM routes WHERE route = 'qualifying')
  SELECT address, 'fold' AS kind, count(*) AS arrivals, string_agg(family, ',' ORDER BY family) AS members, sum(names)::BIGINT AS names, sum(rows)::BIGINT AS rows, min(first_ts) AS first_ts FROM q WHERE n >= 2 GROUP BY address
  UNION ALL SELECT address, 'single', 1, family, names, rows, first_ts FROM q WHERE n < 2""", "pihole"))
def arrival_fold(spark, sf_dir):
    return arrivals.fold_arrivals(_routed(spark, sf_dir)[2].filter("route = 'qualifying'"), least=2)


@register("shape_resolve")
def shape_resolve(spark, sf_dir):
    _, pairs, routes = _routed(spark, sf_dir)
    bursts = names.burst_route(pairs, active=2, peak=2, times=2)
    shapes = arrivals.resolve_shapes(routes, bursts, routes.filter("route = 'qualifying'"))
    return shapes.select("address", "family", "shape", "peak_period", "arrival_period")


@register("calibration_grid", "WITH x AS (SELECT unnest([3, 5]) AS history), y AS (SELECT unnest([1, 2]) AS active), c AS (SELECT 0) " + " UNION ALL ".join(
    f"SELECT {h} AS history, {a} AS active, count(*) AS pairs, count(*) FILTER (route = 'qualifying') AS qualifying, count(*) FILTER (route = 'sync_withheld') AS withheld FROM (" + with_lanes(_ROUTES.format(history=h, active=a) + " SELECT * FROM routes", "pihole") + ")" for h in (3, 5) for a in (1, 2)))
def calibration_grid(spark, sf_dir):
    named, pairs, _ = _routed(spark, sf_dir)
    return arrivals.calibration_grid(named, pairs, REPORT, (3, 5), (1, 2)).drop("digest")
