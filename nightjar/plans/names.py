"""Registered DNS and resolver-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.functions.net import label_score, name_domains
from nightjar.operators import names as ops
from nightjar.plans.projections import dns, domains_sql, pihole, read, with_lanes
from nightjar.registry import register

END = 1_706_600_000.0

_SCORE = """(1.5 * (-(list_sum(list_transform(list_distinct(string_split(@, '')), lambda c: (len(list_filter(string_split(@, ''), lambda x: x = c)) / length(@)::DOUBLE) * log2(len(list_filter(string_split(@, ''), lambda x: x = c)) / length(@)::DOUBLE))))) / 5.169925001442312
  + 0.5 * len(list_distinct(string_split(@, ''))) / length(@)::DOUBLE + len(regexp_extract_all(@, '[0-9]')) / length(@)::DOUBLE - 0.5 * len(regexp_extract_all(@, '[aeiou]')) / length(@)::DOUBLE
  - 0.3 * list_reduce(list_transform(range(1, length(@) + 1), lambda i: len(list_filter(range(i, length(@) + 1), lambda j: substr(@, i, j - i + 1) = repeat(substr(@, i, 1), j - i + 1)))), lambda a, b: greatest(a, b)) / length(@)::DOUBLE)"""
_FACTS = f"""{domains_sql('dns', 'lower(query)')}, lb AS (SELECT name, domain, unnest(CASE WHEN len(l) > len(string_split(domain, '.')) THEN l[1:len(l) - len(string_split(domain, '.'))] ELSE l[1:1] END) AS lab FROM domains),
f AS (SELECT name, domain, max({_SCORE.replace('@', 'lab')}) AS score FROM lb GROUP BY ALL)"""
_CAND = "c AS (SELECT lower(query) AS name, count(*) AS rows, count(DISTINCT src) AS sources, count(*) FILTER (rcode = 3) AS nxdomain, min(ts) AS first_ts, max(ts) AS last_ts FROM dns GROUP BY lower(query))"


@register("label_score", f"SELECT p_name, round_even({_SCORE.replace('@', 'lower(p_name)')}, 6) AS score FROM (SELECT DISTINCT p_name FROM part)")
def label_scores(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.bround(label_score(F.col("p_name")), 6).alias("score"))


@register("max_label_score", with_lanes(f"{_FACTS} SELECT name, domain, length(name) AS length, round_even(score, 6) AS score FROM f", "dns"))
def max_label_score(spark, sf_dir):
    return ops.name_facts(dns(spark, sf_dir)).select("name", "domain", "length", F.bround("score", 6).alias("score"))


_HOSTS = "h AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages), a AS (SELECT host FROM h WHERE host <> '' UNION ALL SELECT regexp_replace(host, '[^.]+$', 'com.tr') FROM h WHERE host <> '' UNION ALL SELECT host || '.lan.' FROM h WHERE host <> '' UNION ALL SELECT 'www.ck' FROM h WHERE host <> '')"


@register("registrable_domain", f"WITH {_HOSTS}, {domains_sql('a', 'host')} SELECT name AS host, domain, len(l) AS parts FROM domains")
def registrable(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host")).filter("host <> ''").distinct()
    forms = F.array(F.col("host"), F.regexp_replace("host", r"[^.]+$", "com.tr"), F.concat("host", F.lit(".lan.")), F.lit("www.ck"))
    names = hosts.select(F.explode(forms).alias("name")).distinct()
    return name_domains(names).select(F.col("name").alias("host"), "domain", F.size("labels").alias("parts"))


_FORMS = ("query", "concat(row_id % 9, '.in-addr.arpa')", "concat('p', row_id % 9, '.local')", "'10.0.0.1'", "'box'", "'co.uk'", "'a..com'", "'x.lan'")
_FORMS_SQL = " UNION ".join(f"SELECT DISTINCT {f} AS name FROM dns" for f in _FORMS)


@register("domain_exclusions", with_lanes(f"""a AS ({_FORMS_SQL}), {domains_sql('a', 'name')}, z AS (SELECT name, domain, len(l) AS n, s FROM domains JOIN dm USING (name, l)),
  r AS (SELECT *, CASE WHEN name LIKE '%..%' THEN 'malformed' WHEN name LIKE '%.arpa' THEN 'ptr-arpa' WHEN name LIKE '%.local' THEN 'mdns-local' WHEN name = '10.0.0.1' THEN 'ip-literal' WHEN name NOT LIKE '%.%' THEN 'single-label' WHEN s IS NULL THEN 'malformed' WHEN s >= n THEN 'public-suffix-only' END AS reason FROM z)
  SELECT name, CASE WHEN reason IS NULL THEN domain END AS domain, reason FROM r""", "dns"))
def domain_exclusions(spark, sf_dir):
    lane = dns(spark, sf_dir)
    return ops.domain_exclusions(lane.select(F.explode(F.array(*[F.expr(f) for f in _FORMS])).alias("name")).distinct())


@register("dns_candidate_enrich", with_lanes(f"""{_CAND}, m AS (SELECT lower(query) AS name, rcode, count(*) AS n FROM dns GROUP BY ALL), j AS (SELECT name, '{{' || string_agg('"' || rcode || '":' || n, ',' ORDER BY rcode::VARCHAR) || '}}' AS rcodes FROM m GROUP BY name)
  SELECT c.*, rcodes, EXISTS (SELECT 1 FROM pihole WHERE event_type = 'gravity_blocked' AND query = c.name) AS blocked FROM c LEFT JOIN j USING (name)""", "dns", "pihole"))
def dns_candidate_enrich(spark, sf_dir):
    return ops.candidates(dns(spark, sf_dir), pihole(spark, sf_dir).filter("event_type = 'gravity_blocked'"))


@register("dns_group_findings", with_lanes(f"""{_FACTS}, {_CAND}, g AS (SELECT domain, count(*) AS names, sum(rows)::BIGINT AS rows, sum(nxdomain)::BIGINT AS nxdomain, max(score) AS top, max(sources) AS most_sources, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM c JOIN f USING (name) WHERE score >= 1.8 GROUP BY domain)
  SELECT domain, CASE WHEN names >= 2 THEN 'group' ELSE 'single' END AS kind, names, rows, nxdomain, round_even(top, 4) AS top_score, most_sources, first_ts, last_ts, CASE WHEN nxdomain / rows::DOUBLE >= 0.5 AND nxdomain >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM g""", "dns"))
def dns_group_findings(spark, sf_dir):
    return ops.group_findings(dns(spark, sf_dir))


@register("dns_below_gate", with_lanes(f"""{_FACTS}, {_CAND}, g AS (SELECT domain, count(*) AS names, max(score) AS top, sum(rows)::BIGINT AS rows, sum(nxdomain)::BIGINT AS nxdomain FROM c JOIN f USING (name) GROUP BY domain)
  SELECT domain, names, rows, nxdomain FROM g WHERE names >= 5 AND top < 3 AND nxdomain / rows::DOUBLE >= 0.15""", "dns"))
def dns_below_gate(spark, sf_dir):
    return ops.below_gate(dns(spark, sf_dir), gate=3.0, nx_share=0.15)


_DISP = """d AS (SELECT query, count(*) FILTER (event_type = 'query') AS queries, count(*) FILTER (event_type = 'forwarded') AS forwarded, count(*) FILTER (event_type = 'cached') AS cached, count(*) FILTER (event_type = 'gravity_blocked') AS blocked,
  count(*) AS total, count(DISTINCT src) AS clients, min(ts) AS first_ts, max(ts) AS last_ts FROM pihole GROUP BY query HAVING count(*) FILTER (event_type = 'query') > 0)"""


@register("pihole_domain_agg", with_lanes(f"""{_DISP}, q AS (SELECT query, qtype, count(*) AS n FROM pihole WHERE qtype IS NOT NULL GROUP BY ALL), j AS (SELECT query, '{{' || string_agg('"' || qtype || '":' || n, ',' ORDER BY qtype) || '}}' AS qtypes FROM q GROUP BY query)
  SELECT d.*, qtypes, CASE WHEN forwarded + cached + blocked > 0 THEN blocked / (forwarded + cached + blocked)::DOUBLE ELSE 0 END AS block_ratio FROM d LEFT JOIN j USING (query)""", "pihole"))
def pihole_domain_agg(spark, sf_dir):
    return ops.domain_dispositions(pihole(spark, sf_dir))


@register("enrich_dns_with_blocks", with_lanes(f"""{_DISP}, x AS (SELECT row_id, replace(query, '.d', '.fam') AS query FROM dns), y AS (SELECT query FROM x UNION ALL SELECT query FROM d), {domains_sql('y', 'query')},
  b AS (SELECT domain, sum(blocked) AS b, sum(forwarded + cached + blocked) AS a FROM d JOIN domains ON name = query GROUP BY 1)
  SELECT row_id, domain, coalesce(b.b / nullif(b.a, 0)::DOUBLE, 0) AS block_ratio, coalesce(b.b > 0, false) AS was_blocked FROM x JOIN domains ON name = query LEFT JOIN b USING (domain)""", "pihole", "dns"))
def enrich_dns_with_blocks(spark, sf_dir):
    named = dns(spark, sf_dir).withColumn("query", F.expr("replace(query, '.d', '.fam')"))
    return ops.enrich_with_blocks(named, ops.domain_dispositions(pihole(spark, sf_dir))).select("row_id", "domain", "block_ratio", "was_blocked")


@register("anchor_facts", with_lanes("SELECT coalesce(event_type, '*') AS event_type, count(*) AS rows, count(ts) AS usable, min(ts) AS first_ts, max(ts) AS last_ts FROM pihole GROUP BY ROLLUP (event_type)", "pihole"))
def anchor_facts(spark, sf_dir):
    return ops.anchor_facts(pihole(spark, sf_dir))


_CELLS = f"""bl AS (SELECT DISTINCT query AS name, floor(ts / 86400)::BIGINT AS day FROM pihole WHERE event_type = 'gravity_blocked'), cells AS (SELECT src AS address, query AS name, floor(({END} - ts) / 86400)::BIGINT AS period, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts
  FROM pihole WHERE event_type = 'query' AND ts <= {END} AND EXISTS (SELECT 1 FROM bl WHERE bl.name = query AND bl.day = floor(ts / 86400)::BIGINT) GROUP BY ALL)"""


def _cells(spark, sf_dir):
    return ops.block_cells(pihole(spark, sf_dir), END)


@register("block_cells", with_lanes(f"{_CELLS} SELECT * FROM cells", "pihole"))
def block_cells(spark, sf_dir):
    return _cells(spark, sf_dir)


@register("burst_route", with_lanes(f"""{_CELLS}, {domains_sql('cells', 'name')}, d AS (SELECT address, domain AS family, period, sum(rows)::BIGINT AS rows FROM cells JOIN domains USING (name) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY address, family ORDER BY rows DESC, period DESC) AS p, count(*) OVER (PARTITION BY address, family) AS active_periods FROM d),
  o AS (SELECT address, family, (2 * median(rows))::BIGINT AS twice_median FROM r WHERE p > 1 GROUP BY ALL)
  SELECT address, family, period AS peak_period, rows AS peak, twice_median, active_periods FROM r JOIN o USING (address, family) WHERE p = 1 AND active_periods >= 2 AND rows >= 2 AND 2 * rows >= 2 * twice_median""", "pihole"))
def burst_route(spark, sf_dir):
    return ops.burst_route(_cells(spark, sf_dir), active=2, peak=2, times=2)


@register("recurring_count", with_lanes(f"{_CELLS}, {domains_sql('cells', 'name')}, p AS (SELECT address, domain AS family FROM cells JOIN domains USING (name) GROUP BY ALL HAVING count(DISTINCT period) >= 4) SELECT count(*) AS pairs, count(DISTINCT family) AS families, count(DISTINCT address) AS addresses FROM p", "pihole"))
def recurring_count(spark, sf_dir):
    return ops.recurring(_cells(spark, sf_dir))


@register("disposition_by_day", with_lanes("""d AS (SELECT floor(ts / 86400)::BIGINT AS day, count(*) FILTER (event_type = 'gravity_blocked') AS gravity_blocked, 0::BIGINT AS regex_blocked, count(*) FILTER (event_type = 'forwarded') AS forwarded, count(*) FILTER (event_type = 'cached') AS cached FROM pihole GROUP BY 1)
  SELECT * FROM d WHERE day > (SELECT max(day) FROM d) - 20""", "pihole"))
def disposition_by_day(spark, sf_dir):
    return ops.disposition_by_day(pihole(spark, sf_dir), last=20)


@register("cadence_gaps", with_lanes("""g AS (SELECT src, query, ts - lag(ts) OVER (PARTITION BY src, query ORDER BY ts, row_id) AS gap FROM pihole WHERE event_type = 'query'), s AS (SELECT src, query, count(*) AS gaps, stddev_pop(gap) / avg(gap) AS cv, median(gap) AS m FROM g WHERE gap < 86400 GROUP BY ALL)
  SELECT src, query, gaps, CASE WHEN gaps >= 3 THEN round_even(cv, 6) END AS cv, CASE WHEN gaps >= 3 THEN round_even(m, 6) END AS median_gap FROM s""", "pihole"))
def cadence_gaps(spark, sf_dir):
    return ops.cadence_gaps(pihole(spark, sf_dir), within=86_400.0, least=3)
