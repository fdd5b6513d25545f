"""Canonical lanes: one table per log family, the only thing that passes from a source to a detector.

Columns may be absent in a source; they are then null here and listed as absent by `present_columns`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES: dict[str, str] = {
    "conn": "src string, dst string, port int, proto string, ts double, bytes long, resp_bytes long, duration double, conn_state string, local_orig boolean",
    "dns": "ts double, src string, query string, resolver string, qtype int, rtt double, ttl array<double>, rcode int, answer array<string>, tc boolean",
    "pihole": "ts double, src string, query string, event_type string, qtype string, host string",
    "syslog": "ts double, host string, program string, raw string, message string",
    "decision": "ts double, host string, outcome string, gate string, actor string, actor_namespace string, target string, source string",
    "ssl": "ts double, src string, dst string, port int, version string, cipher string, curve string, alpn string, sni string, resumed boolean, established boolean, validation_status string, cert_fp string",
    "x509": "ts double, fingerprint string, not_valid_before double, not_valid_after double, self_signed boolean, key_alg string, key_length int",
    "weird": "ts double, name string, src string, source string",
    "cloudtrail": "ts double, event_source string, event_name string, identity_type string, source_ip string, error_code string, aws_region string, event_id string, principal string, lane string, read_write string, raw string",
}

SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")


def schema(lane: str) -> T.StructType:
    return T.StructType.fromDDL(LANES[lane])


def conform(df: DataFrame, lane: str) -> DataFrame:
    """The lane's columns in order and type, absent ones null; others (row_id) stay behind them."""
    names = set(df.columns)
    wanted = schema(lane)
    own = [(F.col(f.name).try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
    return df.select(*own, *[c for c in df.columns if c not in wanted.names])


def present_columns(df: DataFrame, lane: str) -> list[str]:
    return [n for n in schema(lane).names if n in df.columns]
