"""Lanes as deterministic projections of the test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.functions.net import SUFFIXES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), "user_id", "event_type", "value", k.alias("k"))


def _of(column: str, names: dict[str, str]):
    found = F.lit(None).cast("string")
    for have, want in names.items():
        found = F.when(F.col(column) == have, want).otherwise(found)
    return found


#: Suffixes of the lanes' names: plain, of two labels, by a wildcard, and none
SUFFIX = ("com", "co.uk", "com.tr", "lan", "org", "x.ck")
_SUFFIX = "element_at(array({}), cast({{}} as int) + 1)".format(", ".join(f"'{s}'" for s in SUFFIX))
_SUFFIX_SQL = "([{}])[{{}} + 1]".format(", ".join(f"'{s}'" for s in SUFFIX))


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    dst = F.when(F.expr("k % 10 = 0"), F.expr("'10.0.1.' || (k + 1)")).otherwise(F.expr("'203.0.113.' || (k % 40 + 1)"))
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), F.expr("'10.0.0.' || (user_id % 50 + 1)").alias("src"), dst.alias("dst"), F.expr("cast(event_id % 200 + 1 as int)").alias("port"),
        F.expr("if(event_id % 5 = 0, 'udp', 'tcp')").alias("proto"), "ts", F.round(F.col("value") * 1000).cast("long").alias("bytes"), F.expr("if(event_id % 7 = 0, null, event_id * 37 % 20000)").alias("resp_bytes"),
        F.col("value").alias("duration"), _of("event_type", {"click": "SF", "view": "S1", "error": "S0", "signup": "REJ", "purchase": "RSTO"}).alias("conn_state"), F.lit(None).cast("boolean").alias("local_orig"),
    )


def rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections, mostly over IPv4; some addresses are IPv6, IPv4 in IPv6 form, multicast, no address at all, or null."""
    src = F.expr("case when event_id % 97 = 0 then null when event_id % 31 = 0 then '2001:db8:9::' || (user_id % 5) when event_id % 29 = 0 then '::ffff:10.0.0.' || (user_id % 50 + 1) else '10.0.0.' || (user_id % 50 + 1) end")
    dst = F.expr("case when event_id % 101 = 0 then '224.0.0.5' when event_id % 103 = 0 then 'nowhere' when event_id % 11 = 0 then '2001:db8:' || (k % 2) || '::' || (k % 40) when k % 10 = 0 then '10.0.1.' || (k + 1) else '203.0.113.' || (k % 40 + 1) end")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), src.alias("src"), dst.alias("dst"), F.expr("if(event_id % 67 = 0, null, cast(event_id % 200 + 1 as int))").alias("port"),
        F.expr("case when event_id % 53 = 0 then 'icmp' when event_id % 5 = 0 then 'udp' else 'tcp' end").alias("proto"), "ts", F.expr("if(event_id % 59 = 0, null, cast(round(value * 1000) as long))").alias("bytes"), F.expr("if(event_id % 7 = 0, null, event_id * 37 % 20000)").alias("resp_bytes"),
        F.col("value").alias("duration"), _of("event_type", {"click": "SF", "view": "S1", "error": "S0", "signup": "REJ", "purchase": "RSTO"}).alias("conn_state"), F.expr("case event_id % 13 when 0 then false when 1 then true end").alias("local_orig"),
    )


def beacons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conn lane with few destinations and ports, so that flows have rows to be scored by; the source's own times stay."""
    flows = conn(spark, sf_dir)
    return flows.withColumns({"dst": F.expr("'203.0.113.' || (row_id % 2 + 1)"), "port": F.expr("cast(if(row_id % 2 = 0, 443, 8443) as int)")})


def cloudtrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), "ts", F.expr("'p' || (user_id % 12)").alias("principal"), F.expr("if(k % 9 = 0, 'service', 'interactive')").alias("lane"), F.expr("event_type || (k % 25)").alias("event_name"),
        F.expr("'s' || (k % 6)").alias("event_source"), F.expr("'198.51.100.' || (k % 30 + 1)").alias("source_ip"), F.expr("if(event_type = 'error', 'AccessDenied', null)").alias("error_code"),
        F.expr("'r' || (k % 4)").alias("aws_region"), F.expr("case k % 3 when 0 then 'read' when 1 then 'write' else 'unknown' end").alias("read_write"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), "ts", F.expr("'h' || (event_id % 5)").alias("host"), F.expr("if(k % 2 = 0, 'sshd', 'sudo')").alias("gate"), F.expr("if(event_type = 'purchase', 'granted', 'denied')").alias("outcome"),
        F.expr("'u' || (user_id % 15)").alias("actor"), F.lit("unix_user").alias("actor_namespace"), F.expr("'198.51.100.' || (k % 8 + 1)").alias("source"),
    )


def pihole(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _of("event_type", {"click": "query", "view": "query", "signup": "forwarded", "purchase": "cached", "error": "gravity_blocked"})
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), "ts", F.expr("if(event_type in ('click', 'view'), '192.168.1.' || (user_id % 10 + 1), null)").alias("src"), F.expr(f"'n' || (k % 30) || '.fam' || (k % 6) || '.' || {_SUFFIX.format('k % 6')}").alias("query"),
        kind.alias("event_type"), F.expr("case when event_type in ('click', 'view') then if(event_id % 3 = 0, 'A', 'AAAA') end").alias("qtype"), F.lit("pi").alias("host"),
    )


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = "if(k % 3 = 0, 'www', left(md5(cast(event_id as string)), 12))"
    name = F.expr(f"{first} || '.d' || (user_id % 10) || '.' || {_SUFFIX.format('user_id % 10 % 6')}")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), "ts", F.expr("'10.0.0.' || (user_id % 50 + 1)").alias("src"), name.alias("query"), F.expr("if(k % 2 = 0, 1, 28)").alias("qtype"), F.expr("if(event_type = 'error', 3, 0)").alias("rcode"), (F.col("value") / 1000).alias("rtt"),
    )


def syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.expr("event_type || '[*]: user ' || user_id || ' value ' || cast(round(value) as long)")
    return _events(spark, sf_dir).select(F.col("event_id").alias("row_id"), "ts", F.expr("'h' || (user_id % 6)").alias("host"), F.col("event_type").alias("program"), message.alias("message"), message.alias("raw"))


def ssl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("ts"), F.expr("'10.0.0.' || (l_suppkey % 100 + 1)").alias("src"), F.expr("'203.0.113.' || (l_partkey % 60 + 1)").alias("dst"), F.lit(443).alias("port"),
        F.expr("if(l_returnflag = 'A', 'TLSv12', 'TLSv13')").alias("version"), F.expr("'c' || l_linestatus").alias("cipher"), F.expr("if(l_tax = 0, null, 'name')").alias("sni"), F.expr("l_linenumber % 4 = 0").alias("resumed"), F.expr("l_discount < 0.09").alias("established"),
        F.expr("case when l_discount = 0.05 then 'self signed certificate' when l_discount > 0.03 then 'ok' end").alias("validation_status"), F.expr("if(l_returnflag = 'A', 'fp' || (l_partkey % 50), null)").alias("cert_fp"),
    )


def x509(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.expr("'fp' || (p_partkey % 50)").alias("fingerprint"), F.col("p_partkey").cast("double").alias("ts"), F.lit(0.0).alias("not_valid_before"), F.expr("p_size * 86400.0D").alias("not_valid_after"),
        F.expr("1024 + p_size").cast("int").alias("key_length"), F.col("p_brand").alias("key_alg"), F.expr("p_size % 2 = 0").alias("self_signed"),
    )


def weird(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"), "ts", F.expr("event_type || '_' || (k % 7)").alias("name"), F.expr("if(k % 9 = 0, null, '10.0.0.' || (user_id % 50 + 1))").alias("src"),
        F.expr("case when k % 4 = 0 then null when k % 4 < 3 then 'TCP' else 'DNS' end").alias("source"),
    )


def era_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderdate").cast("timestamp").alias("began"), F.lit(443).alias("port"), F.expr("if(o_orderpriority like '1%', 'udp', 'tcp')").alias("proto"), F.col("o_totalprice").alias("duration"))


_E0 = "e0 AS (SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS ts, user_id, event_type, value, (props::JSON ->> '$.k')::INTEGER AS k FROM events)"

#: The same projections for DuckDB, as members of a WITH list
SQL = {
    "conn": """conn AS (SELECT event_id AS row_id, '10.0.0.' || (user_id % 50 + 1) AS src, CASE WHEN k % 10 = 0 THEN '10.0.1.' || (k + 1) ELSE '203.0.113.' || (k % 40 + 1) END AS dst,
      (event_id % 200 + 1)::INTEGER AS port, CASE WHEN event_id % 5 = 0 THEN 'udp' ELSE 'tcp' END AS proto, ts, round(value * 1000)::BIGINT AS bytes,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 37 % 20000 END AS resp_bytes, value AS duration,
      CASE event_type WHEN 'click' THEN 'SF' WHEN 'view' THEN 'S1' WHEN 'error' THEN 'S0' WHEN 'signup' THEN 'REJ' WHEN 'purchase' THEN 'RSTO' END AS conn_state FROM e0)""",
    "rough": """rough AS (SELECT event_id AS row_id,
      CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 31 = 0 THEN '2001:db8:9::' || (user_id % 5) WHEN event_id % 29 = 0 THEN '::ffff:10.0.0.' || (user_id % 50 + 1) ELSE '10.0.0.' || (user_id % 50 + 1) END AS src,
      CASE WHEN event_id % 101 = 0 THEN '224.0.0.5' WHEN event_id % 103 = 0 THEN 'nowhere' WHEN event_id % 11 = 0 THEN '2001:db8:' || (k % 2) || '::' || (k % 40) WHEN k % 10 = 0 THEN '10.0.1.' || (k + 1) ELSE '203.0.113.' || (k % 40 + 1) END AS dst,
      CASE WHEN event_id % 67 = 0 THEN NULL ELSE (event_id % 200 + 1)::INTEGER END AS port, CASE WHEN event_id % 53 = 0 THEN 'icmp' WHEN event_id % 5 = 0 THEN 'udp' ELSE 'tcp' END AS proto, ts,
      CASE WHEN event_id % 59 = 0 THEN NULL ELSE round(value * 1000)::BIGINT END AS bytes, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id * 37 % 20000 END AS resp_bytes, value AS duration,
      CASE event_type WHEN 'click' THEN 'SF' WHEN 'view' THEN 'S1' WHEN 'error' THEN 'S0' WHEN 'signup' THEN 'REJ' WHEN 'purchase' THEN 'RSTO' END AS conn_state,
      CASE event_id % 13 WHEN 0 THEN false WHEN 1 THEN true END AS local_orig FROM e0)""",
    "cloudtrail": """cloudtrail AS (SELECT event_id AS row_id, ts, 'p' || (user_id % 12) AS principal, CASE WHEN k % 9 = 0 THEN 'service' ELSE 'interactive' END AS lane, event_type || (k % 25) AS event_name,
      's' || (k % 6) AS event_source, '198.51.100.' || (k % 30 + 1) AS source_ip, CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS error_code, 'r' || (k % 4) AS aws_region,
      CASE k % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'unknown' END AS read_write FROM e0)""",
    "decisions": """decisions AS (SELECT event_id AS row_id, ts, 'h' || (event_id % 5) AS host, CASE WHEN k % 2 = 0 THEN 'sshd' ELSE 'sudo' END AS gate, CASE WHEN event_type = 'purchase' THEN 'granted' ELSE 'denied' END AS outcome,
      'u' || (user_id % 15) AS actor, 'unix_user' AS actor_namespace, '198.51.100.' || (k % 8 + 1) AS source FROM e0)""",
    "pihole": """pihole AS (SELECT event_id AS row_id, ts, CASE WHEN event_type IN ('click', 'view') THEN '192.168.1.' || (user_id % 10 + 1) END AS src, 'n' || (k % 30) || '.fam' || (k % 6) || '.' || {suffix_k} AS query,
      CASE event_type WHEN 'signup' THEN 'forwarded' WHEN 'purchase' THEN 'cached' WHEN 'error' THEN 'gravity_blocked' ELSE 'query' END AS event_type,
      CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 3 = 0 THEN 'A' ELSE 'AAAA' END END AS qtype FROM e0)""",
    "dns": """dns AS (SELECT event_id AS row_id, ts, '10.0.0.' || (user_id % 50 + 1) AS src, CASE WHEN k % 3 = 0 THEN 'www' ELSE left(md5(event_id::VARCHAR), 12) END || '.d' || (user_id % 10) || '.' || {suffix_user} AS query,
      CASE WHEN k % 2 = 0 THEN 1 ELSE 28 END AS qtype, CASE WHEN event_type = 'error' THEN 3 ELSE 0 END AS rcode, value / 1000 AS rtt FROM e0)""",
    "syslog": "syslog AS (SELECT event_id AS row_id, ts, 'h' || (user_id % 6) AS host, event_type AS program, event_type || '[*]: user ' || user_id || ' value ' || round(value)::BIGINT AS message FROM e0)",
    "ssl": """ssl AS (SELECT epoch_us(l_shipdate) / 1000000.0::DOUBLE AS ts, '10.0.0.' || (l_suppkey % 100 + 1) AS src, '203.0.113.' || (l_partkey % 60 + 1) AS dst, CASE WHEN l_returnflag = 'A' THEN 'TLSv12' ELSE 'TLSv13' END AS version,
      'c' || l_linestatus AS cipher, CASE WHEN l_tax = 0 THEN NULL ELSE 'name' END AS sni, l_linenumber % 4 = 0 AS resumed, l_discount < 0.09 AS established,
      CASE WHEN l_discount = 0.05 THEN 'self signed certificate' WHEN l_discount > 0.03 THEN 'ok' END AS validation_status, CASE WHEN l_returnflag = 'A' THEN 'fp' || (l_partkey % 50) END AS cert_fp FROM lineitem)""",
    "x509": """x509 AS (SELECT p_partkey AS row_id, 'fp' || (p_partkey % 50) AS fingerprint, p_partkey::DOUBLE AS ts, 0.0::DOUBLE AS not_valid_before, p_size * 86400.0::DOUBLE AS not_valid_after, 1024 + p_size AS key_length, p_brand AS key_alg, p_size % 2 = 0 AS self_signed FROM part)""",
    "weird": """weird AS (SELECT event_id AS row_id, ts, event_type || '_' || (k % 7) AS name, CASE WHEN k % 9 = 0 THEN NULL ELSE '10.0.0.' || (user_id % 50 + 1) END AS src,
      CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 < 3 THEN 'TCP' ELSE 'DNS' END AS source FROM e0)""",
    "era_conn": "era_conn AS (SELECT o_orderkey AS row_id, o_orderdate AS began, CASE WHEN o_orderpriority LIKE '1%' THEN 'udp' ELSE 'tcp' END AS proto, o_totalprice AS duration FROM orders)",
}

for _lane, _mark, _at in (("pihole", "{suffix_k}", "k % 6"), ("dns", "{suffix_user}", "user_id % 10 % 6")):
    SQL[_lane] = SQL[_lane].replace(_mark, _SUFFIX_SQL.format(_at))


def domains_sql(source: str, column: str) -> str:
    """WITH members that end in `domains` (name, l, domain) of a table's distinct names, by the public suffix rules."""
    kinds = [("exception" if r[0] == "!" else "wildcard" if r[0] == "*" else "plain", r.lstrip("!*").lstrip(".")) for r in SUFFIXES]
    return f"""sfx(kind, rule) AS (VALUES {", ".join(map(str, kinds))}),
    nl AS (SELECT name, list_filter(string_split(regexp_replace(lower(trim(name)), '[.]+$', ''), '.'), lambda x: x <> '') AS l FROM (SELECT DISTINCT {column} AS name FROM {source}) WHERE name IS NOT NULL),
    nk AS (SELECT name, l, unnest(range(1, len(l) + 1)) AS k FROM nl), tl AS (SELECT *, array_to_string(l[len(l) - k + 1:], '.') AS rule FROM nk),
    dm AS (SELECT name, any_value(l) AS l, coalesce(max(CASE WHEN kind = 'exception' THEN k - 1 END), max(CASE WHEN kind = 'plain' THEN k WHEN kind = 'wildcard' AND k < len(l) THEN k + 1 END)) AS s FROM tl LEFT JOIN sfx USING (rule) GROUP BY name),
    domains AS (SELECT name, l, CASE WHEN s < len(l) THEN array_to_string(l[len(l) - s:], '.') ELSE l[len(l)] END AS domain FROM dm)"""


def with_lanes(body: str, *lanes: str) -> str:
    """DuckDB SQL: the lanes' projections, then the body, which may go on with `name AS (...)` members or SELECT."""
    members = ([_E0] if any("e0" in SQL[x] for x in lanes) else []) + [SQL[x] for x in lanes]
    body = body.strip()
    return "WITH " + ",\n".join(members) + (",\n" if not body.upper().startswith("SELECT") else "\n") + body
