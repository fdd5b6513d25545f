"""Registered flow-cube queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.functions.net import with_domain
from nightjar.operators import cube
from nightjar.plans.projections import conn, pihole, with_lanes
from nightjar.registry import register

_ROWS = "r AS (SELECT row_id, ts, src, dst, port || '/' || proto AS svc, bytes::DOUBLE AS metric, greatest(duration, 0) * 40 AS duration FROM conn)"
_CELLS = f"""{_ROWS}, b AS (SELECT *, floor(ts / 3600)::BIGINT AS f, greatest(floor(ts / 3600), ceil((ts + duration) / 3600) - 1)::BIGINT AS l FROM r), x AS (SELECT *, unnest(range(f, l + 1)) AS bin FROM b),
cells AS (SELECT src, dst, svc, bin, sum(CASE WHEN duration > 0 THEN metric * (least(ts + duration, (bin + 1) * 3600.0::DOUBLE) - greatest(ts, bin * 3600.0::DOUBLE)) / duration ELSE metric END) AS metric, count(*) FILTER (bin = f) AS rows FROM x GROUP BY ALL)"""


def _cells(spark, sf_dir):
    rows = cube.prepare(conn(spark, sf_dir)).withColumn("duration", F.col("duration") * 40)
    return cube.spread(rows, 3600.0)


@register("spread_over_bins", with_lanes(f"{_CELLS} SELECT src, dst, svc, bin, round_even(metric, 3) AS metric, rows FROM cells", "conn"))
def spread_over_bins(spark, sf_dir):
    return _cells(spark, sf_dir).withColumn("metric", F.bround("metric", 3))


@register("topn_other_fold", with_lanes(f"""{_CELLS},
  s AS (SELECT src AS k FROM cells GROUP BY src ORDER BY round_even(sum(metric), 6) DESC, sum(rows) DESC, src LIMIT 10), d AS (SELECT dst AS k FROM cells GROUP BY dst ORDER BY round_even(sum(metric), 6) DESC, sum(rows) DESC, dst LIMIT 10), v AS (SELECT svc AS k FROM cells GROUP BY svc ORDER BY round_even(sum(metric), 6) DESC, sum(rows) DESC, svc LIMIT 10)
  SELECT coalesce(s.k, '(other)') AS src, coalesce(d.k, '(other)') AS dst, coalesce(v.k, '(other)') AS svc, bin, round_even(sum(metric), 3) AS metric, sum(rows)::BIGINT AS rows FROM cells LEFT JOIN s ON src = s.k LEFT JOIN d ON dst = d.k LEFT JOIN v ON svc = v.k GROUP BY ALL""", "conn"))
def topn_other_fold(spark, sf_dir):
    return cube.fold_rare(_cells(spark, sf_dir), 10).withColumn("metric", F.bround("metric", 3))


@register("metric_saturate", with_lanes(f"{_CELLS}, c AS (SELECT *, least(metric, 50000) AS c FROM cells), w AS (SELECT *, sum(c / 50000) OVER (PARTITION BY bin) AS w FROM c) SELECT src, dst, svc, bin, rows, round_even(CASE WHEN w > 1 THEN c / w ELSE c END, 3) AS metric FROM w", "conn"))
def metric_saturate(spark, sf_dir):
    return cube.saturate(_cells(spark, sf_dir), 50_000.0).withColumn("metric", F.bround("metric", 3)).drop("altered")


@register("outer_merge_cells", with_lanes("""c AS (SELECT src, dst, port || '/' || proto AS svc, floor(ts / 86400)::BIGINT AS bin, count(*) AS rows FROM conn WHERE proto = 'tcp' GROUP BY ALL), w AS (SELECT src, dst, port || '/' || proto AS svc, floor(ts / 86400)::BIGINT AS bin, sum(bytes)::DOUBLE AS metric FROM conn WHERE bytes > 20000 GROUP BY ALL)
  SELECT src, dst, svc, bin, coalesce(rows, 0) AS rows, coalesce(metric, 0) AS metric FROM c FULL JOIN w USING (src, dst, svc, bin)""", "conn"))
def outer_merge_cells(spark, sf_dir):
    rows = cube.prepare(conn(spark, sf_dir)).withColumn("bin", F.floor(F.col("ts") / 86400).cast("long"))
    counts = rows.filter("svc LIKE '%/tcp'").groupBy("src", "dst", "svc", "bin").agg(F.count("*").alias("rows"))
    weights = rows.filter("metric > 20000").groupBy("src", "dst", "svc", "bin").agg(F.sum("metric").alias("metric"))
    return cube.merge_cells(counts, weights)


_EDGES = """r AS (SELECT row_id, CASE WHEN row_id % 10000 IN (7, 13) THEN ts - 5184000 WHEN row_id % 10000 = 11 THEN ts + 5184000 ELSE ts END AS ts, CASE WHEN row_id % 10000 = 7 THEN 6000000.0 ELSE duration END AS duration FROM conn),
  b AS (SELECT *, floor((ts - (SELECT min(ts) FROM r)) / 86400)::BIGINT AS bin, (SELECT min(ts) FROM r) AS t0 FROM r), n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), q AS (SELECT quantile_cont(n, 0.75) AS q, count(*) AS bins, sum(n) AS total, max(bin) AS last FROM n),
  e AS (SELECT min(bin) AS lo, max(bin) AS hi FROM n, q WHERE n >= q * 0.05), f AS (SELECT CASE WHEN lo < 6 THEN 0 ELSE lo END AS lo, CASE WHEN last - hi < 6 THEN last ELSE hi END AS hi, bins, total, last FROM e, q),
  g AS (SELECT coalesce(sum(n) FILTER (bin < lo OR bin > hi), 0) AS gone FROM n, f), k AS (SELECT CASE WHEN bins < 8 OR gone * 1000 > total THEN 0 ELSE lo END AS lo, CASE WHEN bins < 8 OR gone * 1000 > total THEN last ELSE hi END AS hi FROM f, g)
  SELECT row_id, ts, duration FROM b, k WHERE bin BETWEEN lo AND hi OR (lo > 0 AND ts < t0 + lo * 86400 AND duration > 0 AND ts + duration > t0 + lo * 86400)"""


@register("trim_sparse_edges", with_lanes(_EDGES, "conn"))
def trim_sparse_edges(spark, sf_dir):
    moved = F.expr("case when row_id % 10000 in (7, 13) then ts - 5184000 when row_id % 10000 = 11 then ts + 5184000 else ts end")
    rows = conn(spark, sf_dir).select("row_id", moved.alias("ts"), F.expr("if(row_id % 10000 = 7, 6000000.0D, duration)").alias("duration"))
    return cube.trim_sparse_edges(rows, 86_400.0)


@register("pihole_attribute_join", with_lanes("""d AS (SELECT *, regexp_replace(query, '^[^.]+[.]', '') AS domain FROM pihole), h AS (SELECT DISTINCT domain, query, CASE event_type WHEN 'gravity_blocked' THEN 'blocked' ELSE event_type END AS svc, floor(ts) AS s FROM d WHERE event_type <> 'query'), c AS (SELECT domain, svc, count(*) AS n FROM h GROUP BY ALL),
  w AS (SELECT domain, svc, n / sum(n) OVER (PARTITION BY domain)::DOUBLE AS metric FROM c)
  SELECT row_id, src, query, coalesce(svc, '(unattributed)') AS svc, round_even(coalesce(metric, 1), 9) AS metric FROM d LEFT JOIN w USING (domain) WHERE event_type = 'query'""", "pihole"))
def pihole_attribute_join(spark, sf_dir):
    lane = with_domain(pihole(spark, sf_dir), "query")
    handled = lane.select("domain", "query", cube.disposition(F.col("event_type")).alias("disposition"), "ts")
    found = cube.attribute(lane.filter("event_type = 'query'").select("row_id", "src", "query", "domain"), handled)
    return found.select("row_id", "src", "query", "svc", F.bround("metric", 9).alias("metric"))


_FLOWS = "cells AS (SELECT src, dst, port % 12 || '/' || proto AS svc, floor(ts / 86400)::BIGINT AS bin, sum(bytes)::DOUBLE AS metric, count(*) AS rows FROM conn GROUP BY ALL), flows AS (SELECT src, dst, svc, sum(metric) AS metric, sum(rows)::BIGINT AS rows, count(*) AS bins FROM cells GROUP BY ALL)"


def _drawn(spark, sf_dir):
    lane = conn(spark, sf_dir).withColumn("svc", F.expr("(port % 12) || '/' || proto"))
    cells = lane.groupBy("src", "dst", "svc", F.floor(F.col("ts") / 86_400).cast("long").alias("bin")).agg(F.sum("bytes").cast("double").alias("metric"), F.count("*").alias("rows"))
    return cube.measures(cells, lane.filter("resp_bytes IS NOT NULL").select("src", "dst", "svc", F.col("bytes").alias("orig"), F.col("resp_bytes").alias("resp")))


@register("cube_series", with_lanes(f"{_FLOWS} SELECT *, sum(metric) OVER (PARTITION BY bin) AS bin_total, round_even(metric / nullif(sum(metric) OVER (PARTITION BY bin), 0), 9) AS share FROM cells", "conn"))
def cube_series(spark, sf_dir):
    return _drawn(spark, sf_dir)[0].withColumn("share", F.bround("share", 9))


@register("cube_flows", with_lanes(f"""{_FLOWS}, v AS (SELECT svc, row_number() OVER (ORDER BY sum(metric) DESC, svc)::INTEGER AS colour FROM flows GROUP BY svc), a AS (SELECT src, dst, port % 12 || '/' || proto AS svc, sum(resp_bytes) / nullif(sum(bytes + resp_bytes), 0)::DOUBLE AS r FROM conn WHERE resp_bytes IS NOT NULL GROUP BY ALL)
  SELECT src, dst, svc, metric, rows, bins, colour, round_even(r, 9) AS response_share FROM flows JOIN v USING (svc) LEFT JOIN a USING (src, dst, svc)""", "conn"))
def cube_flows(spark, sf_dir):
    return _drawn(spark, sf_dir)[1].withColumn("response_share", F.bround("response_share", 9))


_PLACED = lambda side, other: f"""(SELECT '{side}' AS side, k AS identity, total, centre, row_number() OVER (ORDER BY round_even(centre, 6) NULLS LAST, total DESC, k)::INTEGER AS place
  FROM (SELECT f.{side} AS k, sum(metric) AS total, sum(metric * r) / nullif(sum(metric), 0) AS centre FROM flows f JOIN (SELECT {other}, row_number() OVER (ORDER BY sum(metric) DESC, {other}) AS r FROM flows GROUP BY {other}) o USING ({other}) GROUP BY f.{side}))"""  # noqa: E731


@register("cube_measures", with_lanes(f"{_FLOWS} SELECT side, identity, total, round_even(centre, 6) AS centre, place FROM {_PLACED('src', 'dst')} UNION ALL SELECT side, identity, total, round_even(centre, 6), place FROM {_PLACED('dst', 'src')}", "conn"))
def cube_measures(spark, sf_dir):
    return _drawn(spark, sf_dir)[2].withColumn("centre", F.bround("centre", 6))


_PLACES = """k AS (SELECT row_id, ts, src, dst, port % 40 || '/' || proto AS svc, bytes::DOUBLE AS metric, duration FROM conn),
  rs AS (SELECT src, row_number() OVER (ORDER BY sum(metric) DESC, count(*) DESC, src) AS s FROM k GROUP BY src), rd AS (SELECT dst, row_number() OVER (ORDER BY sum(metric) DESC, count(*) DESC, dst) AS d FROM k GROUP BY dst), rv AS (SELECT svc, row_number() OVER (ORDER BY sum(metric) DESC, count(*) DESC, svc) AS v FROM k GROUP BY svc),
  p AS (SELECT k.*, s, d, v FROM k JOIN rs USING (src) JOIN rd USING (dst) JOIN rv USING (svc)), f AS (SELECT DISTINCT s, d, v FROM p),
  cs AS (SELECT l AS "limit", count(DISTINCT (least(s, 31), least(d, 31), least(v, l + 1))) AS groups FROM f, range(1, 17) t(l) GROUP BY l), ch AS (SELECT l AS "limit", count(DISTINCT (least(s, l + 1), least(d, l + 1), least(v, 2))) AS groups FROM f, range(1, 31) t(l) GROUP BY l)"""


def _served(spark, sf_dir):
    return conn(spark, sf_dir).select("row_id", "ts", "src", "dst", F.expr("(port % 40) || '/' || proto").alias("svc"), F.col("bytes").cast("double").alias("metric"), "duration")


@register("limit_curve", with_lanes(f"""{_PLACES} SELECT 'services' AS kind, "limit"::INTEGER AS "limit", groups FROM cs UNION ALL SELECT 'hosts', "limit"::INTEGER, groups FROM ch""", "conn"))
def limit_curve(spark, sf_dir):
    places = cube.ranked(_served(spark, sf_dir).withColumn("rows", F.lit(1)), cube.HOSTS, cube.SERVICES)
    kind = lambda vary, services: cube.limit_curve(places, vary, cube.HOSTS, services).select(F.lit(vary).alias("kind"), "limit", "groups")
    return kind("services", cube.SERVICES).unionByName(kind("hosts", 1))


_WIDTHS = ", ".join(f"({w})" for w in (*cube.WIDTHS[4:], 1_209_600, 1_814_400, 2_419_200, 3_024_000))
# every width that may be tried, from a minute to one bin for the span; a width beyond the first that covers it changes nothing


@register("fit_budget", with_lanes(f"""{_PLACES}, lim AS (SELECT coalesce((SELECT max("limit") FROM cs WHERE groups <= 1200), 1) AS sv, CASE WHEN EXISTS (SELECT 1 FROM cs WHERE groups <= 1200) THEN 30 ELSE coalesce((SELECT max("limit") FROM ch WHERE groups <= 1200), 1) END AS h),
  q AS (SELECT CASE WHEN s <= h THEN src ELSE '(other)' END AS src, CASE WHEN d <= h THEN dst ELSE '(other)' END AS dst, CASE WHEN v <= sv THEN svc ELSE '(other)' END AS svc, ts - (SELECT min(ts) FROM k) AS ts, duration, metric, (SELECT max(ts) - min(ts) FROM k) AS span FROM p, lim),
  w(w) AS (VALUES {_WIDTHS}), x AS (SELECT *, floor(ts / w)::BIGINT AS f, greatest(floor(ts / w), least(ceil((ts + duration) / w) - 1, floor(span / w)))::BIGINT AS l FROM q, w), y AS (SELECT *, unnest(range(f, l + 1)) AS bin FROM x),
  n AS (SELECT w, count(DISTINCT (src, dst, svc, bin)) AS n FROM y GROUP BY w), best AS (SELECT min(w) AS w FROM n WHERE n <= 6000)
  SELECT sv::INTEGER AS services, h::INTEGER AS hosts, w::INTEGER AS width, src, dst, svc, bin, count(*) FILTER (bin = f) AS rows, round_even(sum(CASE WHEN duration > 0 THEN metric * (least(ts + duration, (bin + 1) * w::DOUBLE) - greatest(ts, bin * w::DOUBLE)) / duration ELSE metric END), 3) AS metric
  FROM y, lim WHERE w = (SELECT w FROM best) GROUP BY ALL""", "conn"))
def fit_budget(spark, sf_dir):
    cells, fit = cube.fit_budget(_served(spark, sf_dir), 60, flows=1200, cells=6000)
    chosen = {"hosts": F.lit(fit.hosts), "services": F.lit(fit.services), "width": F.lit(fit.width)}
    return cells.withColumn("metric", F.bround("metric", 3)).withColumns(chosen)
