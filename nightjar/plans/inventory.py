"""Registered queries over an inventory of log files that is derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.plans.projections import _events
from nightjar.registry import register
from nightjar.sources import inventory

SINCE, UNTIL = 1_704_888_000.0, 1_705_708_800.0
# Files of three days each: ordinals, dates, exports, exports that overlap, ordinals that run the wrong way, one log kept twice, dated folders.
_SLOT, _DAY = "cast(floor((ts - 1704067200) / 259200) as bigint)", "date_format(timestamp_seconds(1704067200 + slot * 259200), 'yyyyMMdd')"
_FILE = f"""case user_id % 7 when 0 then '/a/pihole.log' || if(slot = 9, '', '.' || (9 - slot) || '.gz') when 1 then '/a/auth.log' || if(slot = 9, '', '.' || {_DAY}) when 2 then '/b/conn_' || {_DAY} || '_3d.log' when 3 then '/b/dns_' || {_DAY} || '_5d.log'
  when 4 then '/c/app.log.' || slot when 5 then '/c/mail.log.' || (9 - slot) || if(event_id % 2 = 0, '.bz2', '') else '/d/' || date_format(timestamp_seconds(ts), 'yyyy-MM-dd') || if(event_id % 3 = 0, '/conn.log.gz', if(event_id % 3 = 1, '/conn-summary.log', '/conn.10.log')) end"""
_DAY_SQL = "strftime(make_timestamp((1704067200 + slot * 259200) * 1000000), '%Y%m%d')"
_FILES_SQL = f"""e AS (SELECT *, floor((ts - 1704067200) / 259200)::BIGINT AS slot FROM e0), n AS (SELECT ts, user_id % 7 AS kind, CASE user_id % 7 WHEN 0 THEN '/a/pihole.log' || CASE WHEN slot = 9 THEN '' ELSE '.' || (9 - slot) || '.gz' END WHEN 1 THEN '/a/auth.log' || CASE WHEN slot = 9 THEN '' ELSE '.' || {_DAY_SQL} END
  WHEN 2 THEN '/b/conn_' || {_DAY_SQL} || '_3d.log' WHEN 3 THEN '/b/dns_' || {_DAY_SQL} || '_5d.log' WHEN 4 THEN '/c/app.log.' || slot WHEN 5 THEN '/c/mail.log.' || (9 - slot) || CASE WHEN event_id % 2 = 0 THEN '.bz2' ELSE '' END
  ELSE '/d/' || strftime(make_timestamp((ts * 1000000)::BIGINT), '%Y-%m-%d') || CASE event_id % 3 WHEN 0 THEN '/conn.log.gz' WHEN 1 THEN '/conn-summary.log' ELSE '/conn.10.log' END END AS file FROM e),
  inv AS (SELECT file, kind, min(ts) AS first_ts FROM n GROUP BY ALL)"""
_E0 = "e0 AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts, user_id FROM events)"


def _files(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("slot", F.expr(_SLOT))
    return inventory.named(rows.groupBy(F.expr(_FILE).alias("file"), (F.col("user_id") % 7).alias("kind")).agg(F.min("ts").alias("first_ts")))


@register("rotation_file_select", f"""WITH {_E0}, {_FILES_SQL}, s AS (SELECT *, regexp_extract(file, '([^/]*)$', 1) AS name, regexp_replace(file, '[.](gz|bz2|xz)$', '') AS stem FROM inv WHERE kind < 6),
  g AS (SELECT *, CASE kind WHEN 2 THEN '/b/conn' WHEN 3 THEN '/b/dns' ELSE regexp_replace(stem, '[.][0-9]+$', '') END AS family, CASE WHEN kind IN (2, 3) THEN 99999999 - regexp_extract(stem, '_([0-9]+)_', 1)::BIGINT WHEN kind = 1 AND stem LIKE '%.2%' THEN 99999999 - regexp_extract(stem, '[.]([0-9]+)$', 1)::BIGINT
    ELSE coalesce(nullif(regexp_extract(stem, '[.]([0-9]+)$', 1), '')::BIGINT, 0) END AS rank FROM s),
  o AS (SELECT *, lag(first_ts) OVER (PARTITION BY family ORDER BY rank, name) AS newer, coalesce(bool_or(first_ts < {SINCE}) OVER (PARTITION BY family ORDER BY rank, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past, count(*) OVER (PARTITION BY family, stem) AS same, count(*) OVER (PARTITION BY family) AS members FROM g),
  r AS (SELECT *, CASE max(CASE WHEN kind NOT IN (2, 3) AND same > 1 THEN 3 WHEN kind = 3 AND members > 1 THEN 2 WHEN NOT past AND first_ts > newer THEN 1 ELSE 0 END) OVER (PARTITION BY kind) WHEN 3 THEN 'duplicate rotation files' WHEN 2 THEN 'overlapping export windows' WHEN 1 THEN 'rotation order not monotonic' END AS reason FROM o)
  SELECT file, kind, rank, reason, reason IS NOT NULL OR (NOT past AND first_ts <= {UNTIL}) AS chosen FROM r""")
def rotation_file_select(spark, sf_dir):
    """Files of each kind that a window can touch, by their order in a rotation."""
    told = inventory.choose(_files(spark, sf_dir).filter("kind < 6"), SINCE, UNTIL, "kind")
    return told.select("file", "kind", F.col("rank").cast("long").alias("rank"), "reason", "chosen")


@register("discover_partition_prune", f"""WITH {_E0}, {_FILES_SQL}, d AS (SELECT *, regexp_extract(file, '/([0-9-]+)/', 1)::DATE AS dated, regexp_extract(file, '([^/]*)$', 1) AS name FROM inv WHERE kind = 6)
  SELECT file, dated, name, first_ts FROM d WHERE name LIKE 'conn.%' AND epoch(dated) + 86400 > {SINCE} AND epoch(dated) <= {UNTIL}""")
def discover_partition_prune(spark, sf_dir):
    """Primary logs in dated folders that a window can touch."""
    found = inventory.in_folders(inventory.primary(_files(spark, sf_dir).filter("kind = 6"), "conn"), SINCE, UNTIL)
    return found.select("file", "dated", "name", "first_ts")
