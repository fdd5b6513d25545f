"""Registered mining queries: templates, DNS features, density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from nightjar.functions.frames import checkpointed, once
from nightjar.functions.net import label_score, with_domain
from nightjar.operators import mining
from nightjar.operators.density import density_clusters
from nightjar.plans.projections import dns, syslog, with_lanes
from nightjar.registry import register

_WORDS = ("alpha", "beta", "gamma", "delta", "epsilon")
_MESSAGE = "program || '[*]: user ' || (row_id % 97) || ' did ' || {words} || ' for value ' || row_id || ' ok'"


@register("mine_templates", with_lanes("SELECT program || '[*]: user <*> did <*> for value <*> ok' AS template, count(*) AS rows, min(ts) AS first_ts FROM syslog GROUP BY 1", "syslog"))
def mine_templates(spark, sf_dir):
    words = "element_at(array({}), cast(row_id % 5 as int) + 1)".format(", ".join(f"'{w}'" for w in _WORDS))
    rows = syslog(spark, sf_dir).withColumn("message", F.expr(_MESSAGE.format(words=words)))
    return mining.mine_templates(rows).groupBy("template").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"))


def _features(spark, sf_dir):
    rows = dns(spark, sf_dir)
    return mining.dns_features(rows.withColumns({"rtt": F.expr("if(row_id % 9 = 0, null, rtt)"), "ttl": F.expr("array(cast(row_id % 300 as double), 5.0D)"), "answer": F.expr("if(row_id % 4 = 0, null, array('a', 'b'))"), "tc": F.expr("row_id % 10 = 0")}))


_FEATURES = """p AS (SELECT row_id, query, CASE WHEN row_id % 9 <> 0 AND rtt >= 0 THEN ln(1 + rtt) END AS rtt, ln(1 + row_id % 300 + 5) AS ttl, length(query) AS length, len(string_split(query, '.')) AS parts, string_split(query, '.') AS l,
    CASE WHEN row_id % 4 = 0 THEN 0 ELSE 2 END AS answers, (row_id % 10 = 0)::INTEGER AS tc FROM dns), q AS (SELECT row_id, coalesce(rtt, (SELECT median(rtt) FROM p)) AS rtt, (rtt IS NULL)::INTEGER AS rtt_missing, ttl, length, parts, length(l[-1]) AS suffix_len, length(l[-2]) AS domain_len, answers, tc, l[-1] AS suffix, query FROM p)"""
_Z = lambda c: f"round_even(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 5) AS {c}"
_NUMBERS = ("rtt", "rtt_missing", "ttl", "length", "parts", "suffix_len", "domain_len", "answers", "tc")


@register("dns_features", with_lanes(f"{_FEATURES} SELECT row_id, query, suffix, {', '.join(_Z(c) for c in _NUMBERS)} FROM q", "dns"))
def dns_features(spark, sf_dir):
    rows = _features(spark, sf_dir)
    return rows.select("row_id", "query", "suffix", *[F.bround(c, 5).alias(c) for c in _NUMBERS])


def _scored(lane):
    """The lane's names with the score of their first label and the logarithm of the answer's time, on a grid so that equal vectors meet.

    The rows are cut here: they are read for the vectors, for the clusters and for the report, and each name is scored once.
    """
    rows = lane.withColumn("score", once(label_score(F.substring_index("query", ".", 1))))
    return checkpointed(rows.withColumn("x", F.bround("score", 2)).withColumn("y", F.bround(F.log1p(F.col("rtt") * 1000), 1)).drop("rtt"))


@register("density_noise")
def density_noise(spark, sf_dir):
    rows = _scored(dns(spark, sf_dir).select("row_id", "query", "rtt")).select("row_id", "query", "x", "y")
    return density_clusters(rows, ["x", "y"], least_size=60, samples=15, width=0.4)


@register("dns_dense_scan")
def dns_dense_scan(spark, sf_dir):
    rows = _scored(with_domain(dns(spark, sf_dir).select("query", "rtt"), "query"))
    clustered = density_clusters(rows, ["x", "y"], least_size=60, samples=15, width=0.4)
    return mining.dense_scan(clustered, F.col("score"), least=20, high=1.2, high_share=0.5, domain_share=0.1)
