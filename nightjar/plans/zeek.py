"""Registered sensor-log lanes: rows of the test tables are written as log lines by Spark and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.functions.frames import once
from nightjar.plans.projections import dns, read, ssl, syslog, weird, with_lanes, x509
from nightjar.registry import register
from nightjar.sources import zeek


def _json(df, **fields):
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return df.select(F.lit("/logs/a.log").alias("file"), body.alias("value"))


@register("norm_dns", with_lanes("SELECT ts, src, query, '9.9.9.9' AS resolver, qtype, rtt, [60.0, 5.0]::DOUBLE[] AS ttl, rcode, ['a', 'b'] AS answer, row_id % 2 = 0 AS tc FROM dns WHERE row_id % 4 <> 3 AND row_id % 9 <> 0", "dns"))
def norm_dns(spark, sf_dir):
    lane = dns(spark, sf_dir)
    klass = F.expr("case when row_id % 4 = 3 then 3 when row_id % 9 = 0 then null else 1 end")
    fields = {"ts": F.col("ts"), "id.orig_h": F.col("src"), "id.resp_h": F.lit("9.9.9.9"), "query": F.col("query"), "qclass": klass, "qtype": F.col("qtype"), "rtt": F.col("rtt"), "TTLs": F.array(F.lit(60.0), F.lit(5.0)), "rcode": F.col("rcode"), "answers": F.array(F.lit("a"), F.lit("b")), "TC": F.expr("row_id % 2 = 0")}
    return zeek.lane(_json(lane, **fields), "dns")


@register("norm_ssl", with_lanes("SELECT ts, src, dst, 443 AS port, version, cipher, NULL::VARCHAR AS curve, NULL::VARCHAR AS alpn, sni, resumed, established, validation_status, cert_fp FROM ssl", "ssl"))
def norm_ssl(spark, sf_dir):
    lane = ssl(spark, sf_dir)
    flag = lambda c: F.when(F.col(c), "T").otherwise("F")
    cells = [F.col("ts").cast("string"), F.col("src"), F.col("dst"), F.lit("443"), F.col("version"), F.col("cipher"), F.coalesce("sni", F.lit("NONE")), flag("resumed"), flag("established"), F.coalesce("validation_status", F.lit("NONE")), F.coalesce(F.concat("cert_fp", F.lit("; other")), F.lit("EMPTY"))]
    names = ["ts", "id.orig_h", "id.resp_h", "id.resp_p", "version", "cipher", "server_name", "resumed", "established", "validation_status", "cert_chain_fps"]
    rows = lane.select(F.lit("/logs/a.log").alias("file"), once(F.concat_ws("|", *cells)).alias("value"))
    head = [r"#separator \x7c", "#set_separator|; ", "#empty_field|EMPTY", "#unset_field|NONE", "#fields|" + "|".join(names), "#types|" + "|".join("string" for _ in names)]
    marks = lane.agg(F.count("*")).select(F.lit("/logs/a.log").alias("file"), F.explode(F.array(*[F.lit(h) for h in head])).alias("value"))
    return zeek.lane(marks.unionByName(rows), "ssl", tsv=True)


@register("norm_x509", with_lanes("SELECT ts, fingerprint, not_valid_before, not_valid_after, CASE WHEN row_id % 5 <> 0 THEN self_signed END AS self_signed, key_alg, key_length FROM x509", "x509"))
def norm_x509(spark, sf_dir):
    lane = x509(spark, sf_dir)
    fields = {"ts": F.col("ts"), "fingerprint": F.col("fingerprint"), "certificate.not_valid_before": F.col("not_valid_before"), "certificate.not_valid_after": F.col("not_valid_after"), "certificate.key_alg": F.col("key_alg"), "certificate.key_length": F.col("key_length")}
    fields |= {"certificate.subject": F.lit("CN=a"), "certificate.issuer": F.expr("case when row_id % 5 = 0 then null when self_signed then 'CN=a' else 'CN=b' end")}
    return zeek.lane(_json(lane, **fields), "x509")


@register("norm_weird", with_lanes("SELECT ts, name, src, source FROM weird", "weird"))
def norm_weird(spark, sf_dir):
    lane = weird(spark, sf_dir)
    return zeek.lane(_json(lane, **{"ts": F.col("ts"), "name": F.col("name"), "id.orig_h": F.col("src"), "source": F.col("source"), "notice": F.lit(False)}), "weird")


@register("norm_zeek_syslog", with_lanes("""SELECT ts, CASE WHEN row_id % 3 = 0 THEN '10.9.9.9' ELSE host END AS host, program, CASE WHEN row_id % 3 = 0 THEN '' ELSE 'Jan  2 03:04:05 ' || host || ' ' END || replace(message, '[*]', '[' || row_id || ']') AS raw, message, 'DAEMON' AS facility, 'INFO' AS severity FROM syslog WHERE row_id % 7 <> 0""", "syslog"))
def norm_zeek_syslog(spark, sf_dir):
    lane = syslog(spark, sf_dir)
    said = F.concat(F.when(F.expr("row_id % 3 = 0"), "").otherwise(F.concat(F.lit("Jan  2 03:04:05 "), "host", F.lit(" "))), F.expr("replace(message, '[*]', '[' || row_id || ']')"), F.lit("\r\n"))
    fields = {"ts": F.col("ts"), "id.orig_h": F.lit("10.9.9.9"), "facility": F.lit("DAEMON"), "severity": F.lit("INFO"), "message": F.when(F.expr("row_id % 7 <> 0"), said)}
    return zeek.lane(_json(lane, **fields), "syslog")


@register("rename_collision_guard", with_lanes("SELECT 'clash' AS feed, 0::BIGINT AS rows UNION ALL SELECT 'sound', count(*) FROM weird", "weird"))
def rename_collision_guard(spark, sf_dir):
    wire = weird(spark, sf_dir).select("ts", "name", F.col("src").alias("id.orig_h"), "source")
    feeds = {"clash": zeek.guarded(wire.withColumn("src", F.lit("10.0.0.1")), "weird"), "sound": zeek.guarded(wire, "weird")}
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("feed"), "rows") for name, df in feeds.items()]
    return counts[0].unionByName(counts[1])


@register("union_feeds", with_lanes("SELECT ts, name, src, source, NULL::VARCHAR AS peer FROM weird UNION ALL SELECT p_partkey::DOUBLE, p_brand, NULL, NULL, 'second' FROM part", "weird"))
def union_feeds(spark, sf_dir):
    second = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("double").alias("ts"), F.col("p_brand").alias("name"), F.lit("second").alias("peer"))
    return zeek.union_feeds([weird(spark, sf_dir).drop("row_id"), second])
