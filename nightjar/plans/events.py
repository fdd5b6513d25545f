"""Registered system-log, TLS, archive and digest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.operators import archive, digest, events, tls
from nightjar.operators.windows import gap_sessions, merge_intervals, mix, mode, most_distinct_in_range
from nightjar.plans.projections import conn, era_conn, read, ssl, syslog, weird, with_lanes, x509
from nightjar.registry import register

_T = "regexp_replace(message, '\\b\\d+\\b', '<*>', 'g')"
_SESS = "o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < {gap} THEN 0 ELSE 1 END AS o FROM {rows} WINDOW w AS (PARTITION BY host ORDER BY ts, row_id)), s AS (SELECT *, sum(o) OVER (PARTITION BY host ORDER BY ts, row_id) AS session FROM o)"


@register("gap_sessions", with_lanes(_SESS.format(gap=600, rows="syslog") + " SELECT row_id, host, session::BIGINT AS session FROM s", "syslog"))
def sessions(spark, sf_dir):
    return gap_sessions(syslog(spark, sf_dir), ["host"], "ts", 600.0, ["row_id"]).select("row_id", "host", "session")


@register("masked_templates", with_lanes(f"SELECT program, {_T} AS template, count(*) AS rows, min(ts) AS first_ts FROM syslog GROUP BY ALL", "syslog"))
def masked_templates(spark, sf_dir):
    rows = syslog(spark, sf_dir).withColumn("template", events.masked(F.col("message")))
    return rows.groupBy("program", "template").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"))


@register("template_rarity", with_lanes("""t AS (SELECT *, regexp_replace(message, ' value .*', '') AS template FROM syslog), c AS (SELECT template, count(*) AS n FROM t GROUP BY 1),
  k AS (SELECT least((SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM c) WHERE i = greatest(0, floor((SELECT count(*) FROM c) * 20 / 100)::BIGINT - 1)), 10) AS limit_)
  SELECT row_id, template, n AS template_count FROM t JOIN c USING (template), k WHERE n <= limit_""", "syslog"))
def template_rarity(spark, sf_dir):
    rows = syslog(spark, sf_dir).withColumn("template", F.regexp_replace("message", " value .*", ""))
    return events.template_rarity(rows, pct=20.0).select("row_id", "template", "template_count")


@register("burst_collapse", with_lanes(_SESS.format(gap=600, rows="syslog") + " SELECT host, session::BIGINT AS session, count(*) AS lines, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT program) AS programs FROM s GROUP BY host, session HAVING count(*) >= 4", "syslog"))
def burst_collapse(spark, sf_dir):
    return events.burst_collapse(syslog(spark, sf_dir), 600.0)[0]


@register("family_fold", with_lanes("""t AS (SELECT *, regexp_replace(message, ' value .*', '') AS template FROM syslog), c AS (SELECT template, count(*) AS n FROM t GROUP BY 1),
  k AS (SELECT least((SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i FROM c) WHERE i = greatest(0, floor((SELECT count(*) FROM c) * 20 / 100)::BIGINT - 1)), 10) AS limit_), r AS (SELECT t.* FROM t JOIN c USING (template), k WHERE n <= limit_),
  q AS (SELECT *, row_number() OVER (PARTITION BY host, program ORDER BY ts, row_id) AS i FROM r), p AS (SELECT host, program, count(*) AS population FROM syslog GROUP BY ALL)
  SELECT host, program, count(*) AS rare, min(ts) AS first_ts, max(ts) AS last_ts, string_agg(message, chr(10) ORDER BY i) FILTER (i <= 20) AS sample, any_value(population) AS population, CASE WHEN count(*) >= 4 THEN 'family' ELSE 'single' END AS kind FROM q JOIN p USING (host, program) GROUP BY host, program""", "syslog"))
def family_fold(spark, sf_dir):
    lane = syslog(spark, sf_dir).withColumn("template", F.regexp_replace("message", " value .*", ""))
    return events.family_fold(events.template_rarity(lane, pct=20.0), lane)


_ANCH = "a AS (SELECT * FROM syslog WHERE program = 'error'), " + _SESS.format(gap=3600, rows="a") + ", e AS (SELECT host, session AS event, count(*) AS anchors, min(ts) AS start, max(ts) AS \"end\" FROM s GROUP BY host, session)"


@register("boot_events", with_lanes(_ANCH + " SELECT host, event::BIGINT AS event, anchors, start, \"end\" FROM e", "syslog"))
def boot_events(spark, sf_dir):
    return events.anchored_events(syslog(spark, sf_dir), F.col("program") == "error", 3600.0)


_MATCH = _ANCH.replace("s AS (", "sa AS (", 1).replace("o AS (SELECT", "oa AS (SELECT", 1).replace("FROM o)", "FROM oa)", 1).replace("FROM s GROUP BY", "FROM sa GROUP BY", 1) + ", " + _SESS.format(gap=600, rows="syslog") + """,
  b AS (SELECT host, session, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY host, session HAVING count(*) >= 3),
  c AS (SELECT e.host, e.event, e.start, list(b.session ORDER BY abs(b.first_ts - e.start), b.first_ts) FILTER (b.session IS NOT NULL) AS options FROM e LEFT JOIN b ON b.host = e.host AND e.start <= b.last_ts + 600 AND b.first_ts <= e."end" + 600 GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY start) AS i FROM c),
  g AS (SELECT host, 0::BIGINT AS i, NULL::HUGEINT AS pick, []::HUGEINT[] AS taken FROM (SELECT DISTINCT host FROM e)
    UNION ALL SELECT g.host, n.i, p.pick, CASE WHEN p.pick IS NULL THEN taken ELSE list_append(taken, p.pick) END FROM g JOIN n ON n.host = g.host AND n.i = g.i + 1, LATERAL (SELECT list_filter(n.options, lambda x: NOT list_contains(g.taken, x))[1] AS pick) p)
  SELECT e.host, e.event::BIGINT AS event, e.start, e."end", g.pick::BIGINT AS session, CASE WHEN g.pick IS NULL THEN 'standalone' ELSE 'labelled' END AS kind FROM e JOIN n USING (host, event) JOIN g ON g.host = n.host AND g.i = n.i"""


@register("boot_burst_match", with_lanes(_MATCH, "syslog").replace("WITH ", "WITH RECURSIVE ", 1))
def boot_burst_match(spark, sf_dir):
    lane = syslog(spark, sf_dir)
    boots = events.anchored_events(lane, F.col("program") == "error", 3600.0)
    return events.match_boots(boots, events.burst_collapse(lane, 600.0, 3)[0], 600.0)


@register("update_runs", with_lanes(_ANCH + " SELECT host, event::BIGINT AS event, anchors, start, \"end\" FROM e WHERE anchors >= 2", "syslog"))
def update_runs(spark, sf_dir):
    return events.anchored_events(syslog(spark, sf_dir), F.col("program") == "error", 3600.0, 2)


@register("admin_sessions", with_lanes("a AS (SELECT * FROM syslog WHERE program IN ('signup', 'purchase')), " + _SESS.format(gap=7200, rows="a") + """, f AS (SELECT *, min(ts) FILTER (program = 'signup') OVER (PARTITION BY host, session) AS b FROM s),
  g AS (SELECT host, session, min(b) AS start, max(ts) FILTER (program = 'purchase' AND ts >= b) AS "end" FROM f GROUP BY host, session) SELECT host, session::BIGINT AS event, start, "end" FROM g WHERE "end" - start <= 28800""", "syslog"))
def admin_sessions(spark, sf_dir):
    return events.admin_sessions(syslog(spark, sf_dir), F.col("program") == "signup", F.col("program") == "purchase", 7200.0)


@register("suppress_interval_anti", with_lanes(_ANCH + """ SELECT row_id, host, ts FROM syslog x WHERE program = 'signup' AND NOT EXISTS (SELECT 1 FROM e WHERE e.host = x.host AND x.ts BETWEEN e.start - 120 AND e."end" + 600)""", "syslog"))
def suppress_interval_anti(spark, sf_dir):
    lane = syslog(spark, sf_dir)
    windows = events.anchored_events(lane, F.col("program") == "error", 3600.0)
    return events.outside_windows(lane.filter("program = 'signup'"), windows, 120.0, 600.0).select("row_id", "host", "ts")


_CLAIM = _ANCH + """, m AS (SELECT x.row_id, x.host, event, start, row_number() OVER (PARTITION BY x.row_id ORDER BY abs(x.ts - start), start, event) AS r FROM syslog x JOIN e ON e.host = x.host AND x.ts >= start - 60 AND x.ts <= "end" + 120 WHERE program <> 'error'),
  n AS (SELECT *, count(*) OVER (PARTITION BY host, event) AS k FROM m WHERE r = 1)"""


def _claims(spark, sf_dir):
    lane = syslog(spark, sf_dir)
    rows = lane.filter("program <> 'error'").select("row_id", "host", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    return events.claim_intervals(rows, events.anchored_events(lane, F.col("program") == "error", 3600.0)), lane


@register("interval_claim_join", with_lanes(_CLAIM + " SELECT row_id, host, event::BIGINT AS event, start FROM n WHERE k >= 2", "syslog"))
def interval_claim_join(spark, sf_dir):
    return _claims(spark, sf_dir)[0]


@register("transaction_units", with_lanes(_CLAIM + " SELECT n.host, event::BIGINT AS event, count(*) AS lines, count(DISTINCT program) AS programs, min(ts) AS first_ts, max(ts) AS last_ts FROM n JOIN syslog USING (row_id) WHERE k >= 2 GROUP BY n.host, event", "syslog"))
def transaction_units(spark, sf_dir):
    claims, lane = _claims(spark, sf_dir)
    return events.transaction_units(claims, lane)


@register("interval_islands", with_lanes("""i AS (SELECT src, ts AS start, ts + duration * 100 AS "end" FROM conn), n AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY src ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM i),
  g AS (SELECT *, sum(o) OVER (PARTITION BY src ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT src, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY src, k""", "conn"))
def interval_islands(spark, sf_dir):
    spans = conn(spark, sf_dir).select("src", F.col("ts").alias("start"), (F.col("ts") + F.col("duration") * 100).alias("end"))
    return merge_intervals(spans, ["src"], "start", "end")


@register("sliding_distinct", with_lanes("SELECT src, max(n) AS most FROM (SELECT a.src, a.row_id, count(DISTINCT b.port) AS n FROM conn a JOIN conn b ON a.src = b.src AND b.ts BETWEEN a.ts - 86400 AND a.ts GROUP BY ALL) GROUP BY src", "conn"))
def sliding_distinct(spark, sf_dir):
    return most_distinct_in_range(conn(spark, sf_dir), ["src"], "port", "ts", 86_400.0, "most")


@register("mix_stats", with_lanes("""c AS (SELECT src, conn_state, count(*) AS n FROM conn GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, conn_state) AS r, sum(n) OVER (PARTITION BY src) AS a FROM c)
  SELECT src, any_value(conn_state) FILTER (r = 1) AS state, round_even((max(n) FILTER (r = 1)) / any_value(a)::DOUBLE, 6) AS share, string_agg(conn_state || ':' || n, ',' ORDER BY r) FILTER (r <= 3) AS mix FROM r GROUP BY src""", "conn"))
def mix_stats(spark, sf_dir):
    lane = conn(spark, sf_dir)
    top = mode(lane, ["src"], "conn_state", "state", "share").withColumn("share", F.bround("share", 6))
    return top.join(mix(lane, ["src"], "conn_state", "mix"), "src")


_LEGS = "e AS (SELECT *, sni IS NULL AND established AND NOT resumed AS bare, cert_fp IS NOT NULL AND coalesce(validation_status <> 'ok', false) AS bad FROM ssl)"
_SSL = f"""{_LEGS}, p AS (SELECT src, dst, count(*) AS connections, count(*) FILTER (bare) AS no_sni, count(*) FILTER (bad) AS invalid, count(cert_fp) AS visible, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY ALL HAVING count(*) FILTER (bare OR bad) > 0),
v AS (SELECT src, dst, version, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, version) AS r, sum(n) OVER (PARTITION BY src, dst) AS a FROM v),
x AS (SELECT src, dst, any_value(version) FILTER (r = 1) AS version_mode, round_even((max(n) FILTER (r = 1)) / any_value(a)::DOUBLE, 6) AS version_share, string_agg(version || ':' || n, ',' ORDER BY r) FILTER (r <= 3) AS versions FROM w GROUP BY ALL),
f AS (SELECT src, dst, cert_fp, count(*) AS n FROM e WHERE bad GROUP BY ALL), g AS (SELECT src, dst, cert_fp, row_number() OVER (PARTITION BY src, dst ORDER BY n DESC, cert_fp) AS r FROM f),
ssl_pairs AS (SELECT src, dst, connections, no_sni, invalid, first_ts, last_ts, version_mode, version_share, versions, g.cert_fp, round_even(visible / connections::DOUBLE, 6) AS visible_share, CASE WHEN no_sni > 0 AND invalid > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM p JOIN x USING (src, dst) LEFT JOIN (SELECT * FROM g WHERE r = 1) g USING (src, dst))"""


@register("ssl_pairs", with_lanes(f"{_SSL} SELECT * FROM ssl_pairs", "ssl"))
def ssl_pairs(spark, sf_dir):
    return tls.flagged_pairs(ssl(spark, sf_dir), 1)


@register("join_cert_facts", with_lanes(f"""{_SSL}, c AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ts, row_id) AS n FROM x509) SELECT s.src, s.dst, s.cert_fp, not_valid_before, not_valid_after, self_signed, key_alg, key_length FROM ssl_pairs s LEFT JOIN c ON c.fingerprint = s.cert_fp AND c.n = 1""", "ssl", "x509"))
def join_cert_facts(spark, sf_dir):
    out = tls.with_cert_facts(tls.flagged_pairs(ssl(spark, sf_dir), 1), x509(spark, sf_dir))
    return out.select("src", "dst", "cert_fp", "not_valid_before", "not_valid_after", "self_signed", "key_alg", "key_length")


@register("day_shards", with_lanes("d AS (SELECT began::DATE AS day, count(*) AS n FROM era_conn GROUP BY 1) SELECT s.day, coalesce(n, 0) AS rows FROM (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day) s LEFT JOIN d USING (day)", "era_conn"))
def day_shards(spark, sf_dir):
    return archive.day_shards(era_conn(spark, sf_dir))


_WEEK = "g AS (SELECT date_trunc('week', began)::DATE AS week FROM era_conn GROUP BY 1 HAVING count(DISTINCT began::DATE) >= 7)"


@register("eligible_weeks", with_lanes("SELECT date_trunc('week', began)::DATE AS week, count(DISTINCT began::DATE) AS days FROM era_conn GROUP BY 1 HAVING count(DISTINCT began::DATE) >= 7", "era_conn"))
def eligible_weeks(spark, sf_dir):
    return archive.weeks(era_conn(spark, sf_dir))


@register("week_over_week", with_lanes(f"""{_WEEK}, s AS (SELECT date_trunc('week', began)::DATE AS week, count(*) AS rows, avg((proto = 'udp')::INTEGER) AS share FROM era_conn GROUP BY 1), t AS (SELECT s.* FROM s JOIN g USING (week) WHERE rows >= 5),
  m AS (SELECT *, share - lag(share) OVER (ORDER BY week) AS move FROM t) SELECT week, rows, round_even(share, 6) AS share, round_even(move, 6) AS move, move IS NOT NULL AND row_number() OVER (ORDER BY abs(move) DESC NULLS LAST, week) = 1 AS largest FROM m""", "era_conn"))
def week_over_week(spark, sf_dir):
    return archive.week_over_week(era_conn(spark, sf_dir), floor=5)


@register("longest_connection", with_lanes("""SELECT max(duration) AS longest, min(began) FILTER (duration = (SELECT max(duration) FROM era_conn)) AS started, count(*) AS rows, count(duration) AS measured, count(*) FILTER (duration >= 86400) AS over_1d, count(*) FILTER (duration >= 604800) AS over_7d, count(*) FILTER (duration >= 1209600) AS over_14d FROM era_conn""", "era_conn"))
def longest_connection(spark, sf_dir):
    return archive.longest_connection(era_conn(spark, sf_dir)).withColumn("started", F.col("started").cast("timestamp_ntz"))


@register("weekday_shape", with_lanes("d AS (SELECT began::DATE AS day, count(*) AS n FROM era_conn GROUP BY 1) SELECT dayofweek(day)::INTEGER + 1 AS weekday, count(*) AS days, median(n) AS median_rows FROM d GROUP BY 1 HAVING count(*) >= 8", "era_conn"))
def weekday_shape(spark, sf_dir):
    return archive.weekday_shape(era_conn(spark, sf_dir))


@register("sustained_shift", with_lanes(f"""{_WEEK}, w AS (SELECT date_trunc('week', began)::DATE AS week, count(*) AS n FROM era_conn GROUP BY 1), x AS (SELECT w.* FROM w JOIN g USING (week)),
  f AS (SELECT week, median(n) OVER a AS before, median(n) OVER b AS after, count(*) OVER a + count(*) OVER b AS have FROM x WINDOW a AS (ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), b AS (ORDER BY week ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
  SELECT week, before, after, round_even(abs(log2(after / before)), 6) AS shift, row_number() OVER (ORDER BY round_even(abs(log2(after / before)), 6) DESC, week) = 1 AS largest FROM f WHERE have = 8""", "era_conn"))
def sustained_shift(spark, sf_dir):
    return archive.sustained_shift(era_conn(spark, sf_dir))


@register("hosts_seen_cumulative", with_lanes("f AS (SELECT src, min(floor(ts / 86400)::BIGINT) AS bin FROM conn GROUP BY src), n AS (SELECT bin, count(*) AS new FROM f GROUP BY bin) SELECT bin, new, (sum(new) OVER (ORDER BY bin))::BIGINT AS seen FROM n", "conn"))
def hosts_seen_cumulative(spark, sf_dir):
    return archive.seen_cumulative(conn(spark, sf_dir), "src", F.floor(F.col("ts") / 86400).cast("long"))


@register("external_addresses", with_lanes("SELECT count(DISTINCT dst) AS addresses, false AS unclassifiable FROM conn WHERE dst LIKE '203.%'", "conn"))
def external_addresses(spark, sf_dir):
    return archive.external_addresses(conn(spark, sf_dir))


@register("busiest_minute", """WITH m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, minute) AS r FROM m),
  z AS (SELECT coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(minute) FROM m), (SELECT max(minute) FROM m), INTERVAL 1 MINUTE)) AS minute) s LEFT JOIN m USING (minute))
  SELECT a.minute, a.n AS rows, b.n AS runner_up, b.n = a.n AS tie, (SELECT median(n) FROM z) AS median FROM r a, r b WHERE a.r = 1 AND b.r = 2""")
def busiest_minute(spark, sf_dir):
    from nightjar.plans.projections import read

    at = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("began"))
    return archive.busiest_minute(at).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@register("time_histogram", with_lanes("""f AS (SELECT min(ts) AS lo, max(ts) AS hi, ceil((max(ts) - min(ts)) / 86400)::BIGINT AS bins FROM conn), b AS (SELECT least(floor((ts - lo) / 86400)::BIGINT, bins - 1) AS bin, count(*) AS n FROM conn, f GROUP BY 1)
  SELECT s.bin, lo + s.bin * 86400.0::DOUBLE AS start, coalesce(n, 0) AS rows FROM (SELECT unnest(range(0, (SELECT bins FROM f))) AS bin) s CROSS JOIN f LEFT JOIN b USING (bin)""", "conn"))
def time_histogram(spark, sf_dir):
    return digest.time_histogram(conn(spark, sf_dir))


@register("digest_conn", with_lanes("""ends AS (SELECT src AS host FROM conn UNION ALL SELECT dst FROM conn WHERE dst <> src), eh AS (SELECT host AS e, count(*) AS m FROM ends GROUP BY 1), ed AS (SELECT src || ' ' || dst || ' ' || port AS e, count(*) AS m FROM conn GROUP BY 1),
  cl AS (SELECT 'conn_share' AS slot, e, m, row_number() OVER (ORDER BY m DESC, e) AS r, count(*) OVER () AS k FROM eh UNION ALL SELECT 'densest', e, m, row_number() OVER (ORDER BY m DESC, e), count(*) OVER () FROM ed),
  cliff AS (SELECT a.slot, 'cliff' AS statistic, a.e AS entity, a.m::DOUBLE AS magnitude, a.m / b.m::DOUBLE AS ratio FROM cl a JOIN cl b ON a.slot = b.slot AND a.r = 1 AND b.r = 2 WHERE a.k >= 5 AND a.m >= 2 * b.m),
  sp AS (SELECT src AS e, count(DISTINCT dst) AS v FROM conn GROUP BY 1), tail AS (SELECT 'fan_out', 'tail', (SELECT e FROM sp ORDER BY v DESC, e LIMIT 1), max(v)::DOUBLE, max(v) / median(v) FROM sp HAVING count(*) >= 5 AND max(v) >= 1.1 * median(v)),
  ob AS (SELECT src AS e, sum(bytes) AS m FROM conn WHERE dst NOT LIKE '10.%' GROUP BY 1), shr AS (SELECT 'outbound_bytes', 'share', e, m::DOUBLE, m / (SELECT sum(m) FROM ob)::DOUBLE FROM (SELECT * FROM ob ORDER BY m DESC, e LIMIT 1) WHERE m >= 0.01 * (SELECT sum(m) FROM ob)),
  st AS (SELECT conn_state AS e, count(*) AS m FROM conn GROUP BY 1), ds AS (SELECT 'states', 'dist', e, m::DOUBLE, m / (SELECT sum(m) FROM st)::DOUBLE FROM (SELECT * FROM st ORDER BY m DESC, e LIMIT 3)),
  un AS (SELECT src AS e, count(*) AS m FROM conn WHERE conn_state IN ('S0', 'REJ') GROUP BY 1), rt AS (SELECT 'unanswered', 'rate', (SELECT e FROM un ORDER BY m DESC, e LIMIT 1), (SELECT sum(m) FROM un)::DOUBLE, (SELECT sum(m) FROM un) / (SELECT count(*) FROM conn)::DOUBLE),
  a AS (SELECT * FROM cliff UNION ALL SELECT * FROM tail UNION ALL SELECT * FROM shr UNION ALL SELECT * FROM ds UNION ALL SELECT * FROM rt), q AS (SELECT slot, statistic, entity, magnitude, round_even(ratio, 4) AS ratio FROM a)
  SELECT *, CASE WHEN statistic <> 'dist' AND row_number() OVER (ORDER BY statistic = 'dist', ratio DESC, slot, entity) <= 3 THEN 'insight' ELSE 'field' END AS role FROM q""", "conn"))
def digest_conn(spark, sf_dir):
    return digest.conn_card(conn(spark, sf_dir))


@register("largest_outbound", with_lanes("o AS (SELECT * FROM conn WHERE dst LIKE '203.%' AND resp_bytes IS NOT NULL ORDER BY bytes DESC, ts, src DESC, dst DESC LIMIT 1) SELECT bytes, ts, src, dst, false AS unclassifiable FROM o", "conn"))
def largest_outbound(spark, sf_dir):
    return archive.largest_outbound(conn(spark, sf_dir))


@register("capture_loss", "SELECT l_returnflag || l_linestatus AS peer, count(*) AS intervals, sum(l_linenumber * 60)::BIGINT AS seconds, sum(l_linenumber)::BIGINT AS gaps, sum(l_quantity::BIGINT)::BIGINT AS acks, round_even(100 * sum(l_linenumber) / (sum(l_linenumber) + sum(l_quantity::BIGINT))::DOUBLE, 6) AS loss FROM lineitem GROUP BY 1")
def capture_loss(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("peer"), (F.col("l_linenumber") * 60).cast("long").alias("seconds"), F.col("l_linenumber").cast("long").alias("gaps"), F.round("l_quantity").cast("long").alias("acks"))
    return archive.capture_loss(rows)


_TOWER = "SELECT '{slot}' AS slot, 'cliff' AS statistic, (SELECT e FROM {t} ORDER BY m DESC, e LIMIT 1) AS entity, max(m)::DOUBLE AS magnitude, round_even(max(m) / (SELECT m FROM {t} ORDER BY m DESC, e LIMIT 1 OFFSET 1)::DOUBLE, 4) AS ratio FROM {t} HAVING count(*) >= 5"
_MIX = "SELECT * FROM (SELECT '{slot}', 'dist', e, m::DOUBLE, round_even(m / (SELECT sum(m) FROM {t})::DOUBLE, 4) FROM {t} ORDER BY m DESC, e LIMIT 3)"


@register("digest_weird", with_lanes(f"""nm AS (SELECT name AS e, count(*) AS m FROM weird GROUP BY 1), hs AS (SELECT src AS e, count(*) AS m FROM weird WHERE src IS NOT NULL GROUP BY 1), an AS (SELECT coalesce(source, '(none)') AS e, count(*) AS m FROM weird GROUP BY 1),
  q AS ({_TOWER.format(slot='name_volume', t='nm')} UNION ALL {_TOWER.format(slot='host_volume', t='hs')} UNION ALL {_MIX.format(slot='name_mix', t='nm')} UNION ALL {_MIX.format(slot='analyzer_mix', t='an')}
    UNION ALL SELECT 'hostless', 'dist', NULL, count(*)::DOUBLE, round_even(count(*) / (SELECT count(*) FROM weird)::DOUBLE, 4) FROM weird WHERE src IS NULL HAVING count(*) > 0)
  SELECT *, CASE WHEN statistic <> 'dist' THEN 'insight' ELSE 'field' END AS role FROM q""", "weird"))
def digest_weird(spark, sf_dir):
    return digest.weird_card(weird(spark, sf_dir))
