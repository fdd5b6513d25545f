"""Registered query: readable tokens of each host's messages by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import tokens
from nightjar.plans.projections import syslog, with_lanes
from nightjar.registry import register

_MESSAGE = "message || case row_id % 5 when 0 then ' from 10.0.0.' || (row_id % 250) || ':' || (10000000 + row_id) when 1 then ' id ' || md5(cast(row_id as string)) || ',' when 2 then ' serial 7-' || (10000000 + row_id) || ' (ok)' when 3 then '#012' || repeat('z', cast(row_id % 230 as int)) || ' ok' else ' pid 12345678' end"


@register("token_distil", with_lanes("""m AS (SELECT host, floor(ts / 86400)::BIGINT AS day, program || row_id % 7 AS template, ts, row_id, message || CASE row_id % 5 WHEN 0 THEN ' from 10.0.0.' || (row_id % 250) || ':' || (10000000 + row_id) WHEN 1 THEN ' id ' || md5(row_id::VARCHAR) || ',' WHEN 2 THEN ' serial 7-' || (10000000 + row_id) || ' (ok)' WHEN 3 THEN '#012' || repeat('z', row_id % 230) || ' ok' ELSE ' pid 12345678' END AS message FROM syslog),
  f AS (SELECT *, row_number() OVER (PARTITION BY host, day, template ORDER BY ts, row_id) AS nth FROM m), g AS (SELECT *, row_number() OVER (PARTITION BY host, day ORDER BY ts, row_id) AS r FROM f WHERE nth = 1), h AS (SELECT host, day, r, string_split_regex(trim(regexp_replace(replace(message, '#012', ' '), '^[^\\[:\\s]+(\\[[^\\]]*\\])?:', '')), '\\s+') AS w FROM g WHERE r <= 6),
  t AS (SELECT host, day, r, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM h), u AS (SELECT *, trim(token, '()[]{}<>.,;:''"') AS bare FROM t WHERE token <> '' AND (regexp_matches(token, '^10[.]0[.]0[.][0-9]+:[0-9]+$') OR NOT (len(list_filter(regexp_extract_all(token, '[0-9A-Fa-f]+'), lambda x: len(x) >= 8 AND regexp_matches(x, '[A-Fa-f]'))) > 0 OR (regexp_matches(token, '[0-9]{8,}') AND regexp_matches(token, '[0-9][^0-9]+[0-9]'))))),
  d AS (SELECT *, row_number() OVER (PARTITION BY host, day, bare ORDER BY r, i) AS n FROM u), q AS (SELECT host, day, token, row_number() OVER (PARTITION BY host, day ORDER BY r, i) AS pos FROM d WHERE n = 1), k AS (SELECT host, day, list(token ORDER BY pos) AS tokens FROM q GROUP BY ALL)
  SELECT host, day, array_to_string(tokens, ' ') AS tokens FROM k""", "syslog"))
def token_distil(spark, sf_dir):
    rows = syslog(spark, sf_dir).withColumns({"day": F.floor(F.col("ts") / 86_400).cast("long"), "template": F.expr("program || (row_id % 7)"), "message": F.expr(_MESSAGE)})
    return tokens.distil(rows, ["host", "day"], ["ts", "row_id"]).select("host", "day", F.array_join("tokens", " ").alias("tokens"))
