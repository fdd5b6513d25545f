"""TLS set-up anomalies and certificate facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.net import HOME_NET, classify_addresses
from nightjar.operators.windows import mix, mode


def eligible(ssl: DataFrame, home_net=HOME_NET) -> DataFrame:
    """Rows from home to a routable destination outside, with a finite time."""
    faced = classify_addresses(ssl, ["src", "dst"], home_net)
    return faced.filter("src_facts.local AND dst_facts.external AND ts IS NOT NULL AND NOT isnan(ts)").drop("src_facts", "dst_facts")


def _legs(ssl: DataFrame) -> DataFrame:
    no = F.lit(False)
    bare = F.coalesce((F.coalesce("sni", F.lit("")) == "") & F.col("established") & ~F.col("resumed"), no)
    bad = F.coalesce(F.col("cert_fp").isNotNull() & (F.col("validation_status") != "ok"), no)
    return ssl.withColumn("no_sni", bare).withColumn("invalid", bad)


def flagged_pairs(ssl: DataFrame, least: int = 3) -> DataFrame:
    """(src, dst) pairs with a flagged row: leg counts, version mode and share, mixes, certificate visibility, severity."""
    rows = _legs(eligible(ssl))
    keys = ["src", "dst"]
    pairs = rows.groupBy(*keys).agg(
        F.count("*").alias("connections"), F.count_if("no_sni").alias("no_sni"), F.count_if("invalid").alias("invalid"), F.count_if(F.col("cert_fp").isNotNull()).alias("visible"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    ).filter((F.col("connections") >= least) & ((F.col("no_sni") > 0) | (F.col("invalid") > 0)))
    flagged = rows.join(pairs.select(*keys), keys, "left_semi")
    out = pairs.join(mode(flagged, keys, "version", "version_mode", "version_share"), keys, "left").join(mix(flagged, keys, "version", "versions"), keys, "left").join(mode(flagged.filter("invalid"), keys, "cert_fp", "cert_fp"), keys, "left")
    severity = F.when((F.col("no_sni") > 0) & (F.col("invalid") > 0), "MEDIUM").otherwise("LOW")
    return out.withColumns({"visible_share": F.bround(F.col("visible") / F.col("connections"), 6), "version_share": F.bround("version_share", 6), "severity": severity}).drop("visible")


def with_cert_facts(pairs: DataFrame, x509: DataFrame) -> DataFrame:
    """Pairs with the facts of their certificate's earliest row: all five, or none if one is missing."""
    first = Window.partitionBy("fingerprint").orderBy("ts", "row_id")
    facts = x509.filter("ts IS NOT NULL AND NOT isnan(ts)").withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    names = ("not_valid_before", "not_valid_after", "self_signed", "key_alg", "key_length")
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    facts = facts.filter(whole).select(F.col("fingerprint").alias("cert_fp"), *names)
    return pairs.join(facts, "cert_fp", "left")
