"""Registered queries on what exports vouch for; exports are three-day slices of the events, faults are planted by feed and slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import coverage
from nightjar.plans.projections import _events
from nightjar.registry import register

_T0, _SLOT = 1_704_067_200, 259_200
_OBJECTS_SQL = f"""WITH e AS (SELECT user_id % 9 AS feed, floor((epoch_us(ts) / 1000000.0::DOUBLE - {_T0}) / {_SLOT})::BIGINT AS slot, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts FROM events),
  o AS (SELECT feed, '/x/' || feed AS folder, feed || '_' || slot || '.log' AS name, slot, count(*) AS size, sha256(sum(event_id)::VARCHAR) AS sha256 FROM e WHERE NOT (feed = 2 AND slot = 4) GROUP BY feed, slot),
  x AS (SELECT *, CASE WHEN feed = 3 AND slot = 5 THEN size + 1 ELSE size END AS m_size, CASE WHEN feed = 3 AND slot = 6 THEN md5(sha256) ELSE upper(sha256) END AS m_sha, CASE WHEN feed = 4 AND slot = 2 THEN 'partial' ELSE 'success' END AS completion,
    {_T0} + slot * {_SLOT} + CASE WHEN feed = 6 AND slot = 3 THEN 1 ELSE 0 END AS starts, {_T0} + (slot + 1) * {_SLOT} + CASE WHEN feed = 1 THEN 3600 ELSE 0 END AS ends, feed = 7 AND slot = 1 AS missing FROM o),
  f AS (SELECT feed, folder, name, size, sha256, CASE WHEN feed = 5 THEN 'manifest_missing' WHEN feed = 8 THEN 'manifest_malformed' WHEN missing THEN 'entry_missing' WHEN completion <> 'success' THEN 'incomplete' WHEN size <> m_size OR sha256 <> lower(m_sha) THEN 'binding_mismatch' ELSE 'trusted' END AS reason, starts AS s, ends AS t FROM x),
  facts AS (SELECT feed, folder, name, size, sha256, reason = 'trusted' AS trusted, reason, CASE WHEN reason = 'trusted' THEN s END AS starts, CASE WHEN reason = 'trusted' THEN t END AS ends FROM f),
  i AS (SELECT *, CASE WHEN starts <= max(ends) OVER (PARTITION BY feed ORDER BY starts, ends ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opened FROM facts WHERE trusted),
  spans AS (SELECT feed, min(starts) AS starts, max(ends) AS ends FROM (SELECT *, sum(opened) OVER (PARTITION BY feed ORDER BY starts, ends ROWS UNBOUNDED PRECEDING) AS g FROM i) GROUP BY feed, g),
  reports AS (SELECT feed, CASE WHEN feed = 10 THEN NULL ELSE {_T0} + 20 * 86400 END AS starts, {_T0} + 25 * 86400 + CASE feed WHEN 11 THEN -864000 ELSE 0 END AS ends, {_T0} + 2 * 86400 AS since FROM range(0, 12) t(feed)),
  told AS (SELECT r.*, CASE WHEN starts IS NULL OR ends <= starts THEN 'interval_unbounded' WHEN NOT EXISTS (SELECT 1 FROM facts q WHERE q.feed = r.feed) THEN 'no_objects' WHEN EXISTS (SELECT 1 FROM facts q WHERE q.feed = r.feed AND NOT trusted) THEN 'object_unknown'
    WHEN EXISTS (SELECT 1 FROM spans q WHERE q.feed = r.feed AND q.starts <= r.starts AND q.ends >= r.ends) THEN 'complete' ELSE 'interval_gap' END AS why FROM reports r)"""


def _exports(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.col("user_id") % 9).alias("feed"), F.floor((F.col("ts") - _T0) / _SLOT).cast("long").alias("slot"), "event_id", "ts")
    o = e.filter("NOT (feed = 2 AND slot = 4)").groupBy("feed", "slot").agg(F.count("*").alias("size"), F.sha2(F.sum("event_id").cast("string"), 256).alias("sha256"))
    o = o.withColumns({"folder": F.expr("'/x/' || feed"), "name": F.expr("feed || '_' || slot || '.log'")})
    entries = o.filter("feed <> 5 AND NOT (feed = 7 AND slot = 1)").select(
        "folder", "name", F.expr("if(feed = 3 AND slot = 5, size + 1, size)").alias("size"), F.expr("if(feed = 3 AND slot = 6, md5(sha256), upper(sha256))").alias("sha256"), F.expr("if(feed = 4 AND slot = 2, 'partial', 'success')").alias("completion"),
        F.expr(f"{_T0} + slot * {_SLOT} + if(feed = 6 AND slot = 3, 1, 0)").alias("starts"), F.expr(f"{_T0} + (slot + 1) * {_SLOT} + if(feed = 1, 3600, 0)").alias("ends"),
    )
    entries = entries.unionByName(entries.filter("name = '8_0.log'"))  # named twice
    manifests = o.filter("feed <> 5").select("folder", F.lit("ok").alias("state")).distinct()
    return e, coverage.availability(o.select("feed", "folder", "name", "size", "sha256"), manifests, entries, ("feed",))


def _told(spark, facts):
    reports = spark.range(0, 12).selectExpr("id AS feed", f"if(id = 10, null, {_T0} + 20 * 86400L) AS starts", f"{_T0} + 25 * 86400L + if(id = 11, -864000L, 0L) AS ends", f"{_T0} + 2 * 86400L AS since")
    return coverage.verdicts(reports, facts, ["feed"])


@register("availability_facts", f"{_OBJECTS_SQL} SELECT * FROM facts")
def availability_facts(spark, sf_dir):
    return _exports(spark, sf_dir)[1]


@register("interval_coverage", f"{_OBJECTS_SQL} SELECT feed, starts, ends, since, why, why = 'complete' AS strong FROM told")
def interval_coverage(spark, sf_dir):
    return _told(spark, _exports(spark, sf_dir)[1])


@register("covered_periods", f"""{_OBJECTS_SQL}, p AS (SELECT told.*, unnest(range(0, (ends - since) // 86400)) AS period FROM told WHERE why = 'complete')
  SELECT feed, period::BIGINT AS period FROM p WHERE EXISTS (SELECT 1 FROM spans q WHERE q.feed = p.feed AND q.starts <= p.ends - (period + 1) * 86400 AND q.ends >= p.ends - period * 86400)
  UNION ALL SELECT DISTINCT feed, floor(({_T0} + 25 * 86400 - ts) / 86400)::BIGINT FROM e JOIN told USING (feed) WHERE why <> 'complete' AND ts <= {_T0} + 25 * 86400 AND ts > {_T0} + 2 * 86400""")
def covered_periods(spark, sf_dir):
    rows, facts = _exports(spark, sf_dir)
    seen = rows.filter(F.col("ts").between(_T0 + 2 * 86400 + 1e-6, _T0 + 25 * 86400)).select("feed", F.floor((_T0 + 25 * 86400 - F.col("ts")) / 86400).cast("long").alias("period"))
    return coverage.covered_periods(_told(spark, facts), facts, ["feed"], seen).withColumn("period", F.col("period").cast("long"))
