"""Registered ledger and daily-state queries over archive weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import ledger
from nightjar.plans.projections import era_conn, with_lanes
from nightjar.registry import register

_NAME = """case row_id % 8 when 0 then 'h' || (row_id % 3) || '.once' || row_id || '.com' when 1 then 'printer' when 2 then '10.0.0.' || (row_id % 200) when 3 then 'www.c' || (row_id % 200) || '.org'
  when 4 then if(began >= timestamp'1993-02-01', 'x.m' || (row_id % 32) || '.net', 'cdn.early.net') when 5 then 'w' || (row_id % 5) || '.daily.org' when 6 then if(year(began) = 1994, 'a.spring.org', 'mail.daily.org') else 'nas.local' end"""
_NAME_SQL = _NAME.replace("if(began >= timestamp'1993-02-01', 'x.m' || (row_id % 32) || '.net', 'cdn.early.net')", "CASE WHEN began >= TIMESTAMP '1993-02-01' THEN 'x.m' || (row_id % 32) || '.net' ELSE 'cdn.early.net' END").replace("if(year(began) = 1994, 'a.spring.org', 'mail.daily.org')", "CASE WHEN year(began) = 1994 THEN 'a.spring.org' ELSE 'mail.daily.org' END")

_LEDGER = f"""q AS (SELECT *, date_trunc('week', began)::DATE AS week, {_NAME_SQL} AS query FROM era_conn),
  d AS (SELECT DISTINCT began::DATE AS day FROM era_conn), g AS (SELECT day, day(day) % 9 <> 0 AS good FROM d), wk AS (SELECT date_trunc('week', day)::DATE AS week, count(*) FILTER (good) AS days FROM g GROUP BY 1 HAVING count(*) = 7 AND count(*) FILTER (good) >= 6),
  weeks AS (SELECT week, days, row_number() OVER (ORDER BY week) - 1 AS idx, count(*) OVER () AS span FROM wk),
  n AS (SELECT week, CASE WHEN query = 'printer' OR query LIKE '10.%' OR query LIKE '%.local' THEN NULL ELSE regexp_extract(query, '[^.]+[.][^.]+$') END AS domain FROM q),
  s AS (SELECT DISTINCT domain, idx, span FROM n JOIN weeks USING (week) WHERE domain IS NOT NULL), f AS (SELECT domain, idx, span, min(idx) OVER (PARTITION BY domain) AS arrival FROM s),
  h AS (SELECT domain, span, arrival, span - 1 - arrival AS follow, count(*) AS weeks, CASE WHEN span <= 21 THEN 4 WHEN span <= 28 THEN 6 ELSE 8 END AS maturity, count(*) FILTER (idx > arrival AND idx <= arrival + 4) > 0 AS back, max(idx) >= arrival + 8 AS later FROM f GROUP BY domain, span, arrival),
  k AS (SELECT *, CASE WHEN arrival < 2 THEN 'early' WHEN follow < maturity THEN 'censored' WHEN weeks = 1 THEN 'single-week' WHEN weeks / (follow + 1)::DOUBLE < 0.75 THEN 'intermittent' ELSE 'regular' END AS presence, arrival >= 2 AND follow >= 8 AS cohort FROM h),
  r AS (SELECT w.week, w.days, count(k.domain) AS arrivals, count(k.domain) / w.days::DOUBLE AS rate FROM weeks w LEFT JOIN k ON k.arrival = w.idx WHERE w.idx >= 2 GROUP BY w.week, w.days)"""


def _ledger(spark, sf_dir):
    rows = era_conn(spark, sf_dir).withColumn("query", F.expr(_NAME))
    days = rows.select(F.to_date("began").alias("day")).distinct()
    observed = days.select("day", F.lit(True).alias("present"), F.expr("day(day) % 9 <> 0").alias("usable"))
    return ledger.week_presence(rows), ledger.usable_weeks(days, observed)


@register("domain_histories", with_lanes(f"{_LEDGER} SELECT domain, span, arrival, weeks, presence, cohort, cohort AND back AS soon, cohort AND later AS late FROM k", "era_conn"))
def domain_histories(spark, sf_dir):
    return ledger.domain_histories(*_ledger(spark, sf_dir))


@register("domain_arrivals", with_lanes(f"""{_LEDGER}, c AS (SELECT count(*) FILTER (presence = 'early') AS early, count(*) FILTER (presence = 'single-week') AS single_week, count(*) FILTER (presence = 'intermittent') AS intermittent, count(*) FILTER (presence = 'regular') AS regular,
    count(*) FILTER (presence = 'censored') AS censored, count(*) FILTER (cohort) AS cohort, count(*) FILTER (cohort AND back) AS soon, count(*) FILTER (cohort AND later) AS late FROM k),
  m AS (SELECT coalesce(quantile_cont(rate, 0.5), 0) AS median_rate, max(rate) AS peak_rate FROM r), p AS (SELECT min(week) AS peak_week FROM r, m WHERE rate = peak_rate), z AS (SELECT count(*) AS span FROM weeks), o AS (SELECT count(*) FILTER (domain IS NULL) AS excluded FROM n), ok AS (SELECT span >= 12 AS ok FROM z)
  SELECT span, CASE WHEN ok THEN CASE WHEN span <= 21 THEN 4 WHEN span <= 28 THEN 6 ELSE 8 END END AS maturity, excluded, CASE WHEN ok THEN round_even(median_rate, 9) END AS median_rate, CASE WHEN ok THEN round_even(peak_rate, 9) END AS peak_rate, CASE WHEN ok THEN peak_week END AS peak_week,
    {", ".join(f"CASE WHEN ok THEN {x} END AS {x}" for x in ("early", "single_week", "intermittent", "regular", "censored", "cohort", "soon", "late"))} FROM z, c, m, p, o, ok""", "era_conn"))
def domain_arrivals(spark, sf_dir):
    return ledger.domain_arrivals(*_ledger(spark, sf_dir)).withColumns({c: F.bround(c, 9) for c in ("median_rate", "peak_rate")})


@register("arrival_weeks", with_lanes(f"{_LEDGER} SELECT week, days, arrivals, round_even(rate, 9) AS rate FROM r", "era_conn"))
def arrival_weeks(spark, sf_dir):
    presence, weeks = _ledger(spark, sf_dir)
    return ledger.arrival_weeks(ledger.domain_histories(presence, weeks), weeks).withColumn("rate", F.bround("rate", 9))


@register("usable_weeks", with_lanes(f"{_LEDGER} SELECT week, days, idx AS index, span FROM weeks", "era_conn"))
def usable_weeks(spark, sf_dir):
    return _ledger(spark, sf_dir)[1]


@register("mergeable_reduce", with_lanes("""w AS (SELECT *, date_trunc('month', began)::DATE AS month FROM era_conn), t AS (SELECT month, duration AS longest, began AS started, row_number() OVER (PARTITION BY month ORDER BY duration DESC, began) AS r FROM w WHERE duration IS NOT NULL),
  k AS (SELECT month, count(DISTINCT row_id % 50) AS keys, count(row_id) AS key_rows FROM w GROUP BY month)
  SELECT month, count(DISTINCT began::DATE) AS days, count(*) AS rows, count(duration) AS measured, count(*) FILTER (duration >= 86400) AS over_1d, count(*) FILTER (proto = 'udp') AS udp, count(*) FILTER (proto = 'tcp') AS tcp, min(began) AS first, max(began) AS last,
    round_even(count(*) FILTER (proto = 'udp') / count(*)::DOUBLE, 9) AS udp_share, any_value(longest) AS longest, any_value(started) AS started, any_value(keys) AS keys, any_value(key_rows) AS key_rows FROM w LEFT JOIN (SELECT * FROM t WHERE r = 1) USING (month) LEFT JOIN k USING (month) GROUP BY month""", "era_conn"))
def mergeable_reduce(spark, sf_dir):
    rows = era_conn(spark, sf_dir).withColumn("key", F.expr("row_id % 50"))
    month = F.to_date(F.date_trunc("month", "day")).alias("month")
    merged = ledger.merge_days(ledger.day_states(rows), month).join(ledger.merge_keys(ledger.day_keys(rows, "key"), "key", month), "month", "left")
    return merged.withColumn("udp_share", F.bround("udp_share", 9)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last", "started")})
