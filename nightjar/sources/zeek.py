"""Sensor logs of the DNS, TLS, certificate, anomaly and system-log kinds to lanes, from JSON or tab-separated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions.frames import counted, once
from nightjar.lanes import conform, schema
from nightjar.sources.text import usable_ts

# Wire names and types of the logs' fields, by kind of log.
FIELDS = {
    "dns": {"ts": "double", "id.orig_h": "string", "id.resp_h": "string", "query": "string", "qclass": "int", "qtype": "int", "rtt": "double", "TTLs": "array<double>", "rcode": "int", "answers": "array<string>", "TC": "boolean"},
    "ssl": {"ts": "double", "id.orig_h": "string", "id.resp_h": "string", "id.resp_p": "int", "version": "string", "cipher": "string", "curve": "string", "next_protocol": "string", "server_name": "string", "resumed": "boolean", "established": "boolean", "validation_status": "string", "cert_chain_fps": "array<string>"},
    "x509": {"ts": "double", "fingerprint": "string", "certificate.not_valid_before": "double", "certificate.not_valid_after": "double", "certificate.key_alg": "string", "certificate.key_length": "int", "certificate.subject": "string", "certificate.issuer": "string"},
    "weird": {"ts": "double", "name": "string", "id.orig_h": "string", "source": "string"},
    "syslog": {"ts": "double", "id.orig_h": "string", "facility": "string", "severity": "string", "message": "string"},
}
# Lane names of the fields that are named otherwise there.
NAMES = {
    "dns": {"id.orig_h": "src", "id.resp_h": "resolver", "TTLs": "ttl", "answers": "answer", "TC": "tc"},
    "ssl": {"id.orig_h": "src", "id.resp_h": "dst", "id.resp_p": "port", "server_name": "sni", "next_protocol": "alpn"},
    "x509": {f"certificate.{n}": n for n in ("not_valid_before", "not_valid_after", "key_alg", "key_length")},
    "weird": {"id.orig_h": "src"},
}
#: Kinds whose lane stays empty where a source holds a field under both its wire and its lane name
GUARDED = ("ssl", "x509", "weird")


def collides(kind: str, columns: list[str]) -> bool:
    """Whether a source holds a field under both names, so that it can't be told which one counts."""
    return kind in GUARDED and any(wire in columns and name in columns for wire, name in NAMES[kind].items())


def json_fields(lines: DataFrame, kind: str) -> DataFrame:
    """Wire fields of JSON objects, one a line; comments, blank and malformed lines and other values go.

    Both names of a guarded field are read, so that a collision shows; a row of a colliding file is not used.
    """
    kinds = FIELDS[kind] | ({name: FIELDS[kind][wire] for wire, name in NAMES[kind].items()} if kind in GUARDED else {})
    shape = T.StructType([T.StructField(w, T._parse_datatype_string(t)) for w, t in kinds.items()])
    rows = lines.filter(F.col("value").rlike(r"^\s*\{")).select("file", F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("r")).filter("r IS NOT NULL")
    fields = [F.col("r").getField(w).alias(w) for w in FIELDS[kind]]
    if kind not in GUARDED:
        return rows.select(*fields)
    both = F.lit(False)
    for wire, name in NAMES[kind].items():
        if wire != name:
            both = both | (F.col("r").getField(wire).isNotNull() & F.col("r").getField(name).isNotNull())
    clashing = rows.filter(both).select("file").distinct()  # a file a row
    return rows.join(clashing, "file", "left_anti").select(*fields)


# What a header says unless it says otherwise.
_SEPARATOR, _SET, _EMPTY, _UNSET = "\t", ",", "(empty)", "-"


def tsv_headers(lines: DataFrame) -> DataFrame:
    """(file, names, separator, set_separator, empty, unset, types) of each file's header lines; of repeated headers the first counts.

    The first line of a kind is told by its place, so a header that a file repeats after a rotation doesn't change the reading.
    """
    head = lines.filter(F.col("value").startswith("#")).select("file", "value", F.monotonically_increasing_id().alias("at"))
    first = lambda mark: F.min_by(F.when(F.col("value").startswith(mark), F.col("value")), F.when(F.col("value").startswith(mark), F.col("at")))
    marks = head.groupBy("file").agg(*[first(f"#{m}").alias(f"_{m}") for m in ("separator", "set_separator", "empty_field", "unset_field", "fields", "types")]).filter("_fields IS NOT NULL")
    coded = F.regexp_extract("_separator", r"^#separator\s+\\x([0-9A-Fa-f]{2})\s*$", 1)
    plain = F.regexp_extract("_separator", r"^#separator\s(.+)$", 1)
    separator = F.when(F.coalesce(coded, F.lit("")) != "", F.char(F.conv(coded, 16, 10).cast("int"))).when(F.coalesce(plain, F.lit("")) != "", plain).otherwise(_SEPARATOR)
    told = marks.withColumn("separator", separator)
    rest = lambda mark, default: F.coalesce(F.get(_split(F.col(f"_{mark}"), F.col("separator")), F.lit(1)), F.lit(default))
    many = lambda mark: F.slice(_split(F.col(f"_{mark}"), F.col("separator")), F.lit(2), F.size(_split(F.col(f"_{mark}"), F.col("separator"))))
    return told.select("file", "separator", rest("set_separator", _SET).alias("set_separator"), rest("empty_field", _EMPTY).alias("empty"), rest("unset_field", _UNSET).alias("unset"), many("fields").alias("names"), many("types").alias("types"))


def _literal(text: Column) -> Column:
    """A pattern of that very text; a single sign is escaped, as such a split compiles no pattern a row."""
    return F.when(text.rlike(r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]$"), F.concat(F.lit("\\"), text)).otherwise(F.concat(F.lit(r"\Q"), text, F.lit(r"\E")))


def _split(text: Column, separator: Column) -> Column:
    return F.split(text, _literal(separator))


def tsv_fields(lines: DataFrame, kind: str) -> DataFrame:
    """Wire fields of separated lines with a header in each file. Lines with another number of cells go; unset cells are null, empty containers empty."""
    heads = tsv_headers(lines)
    if kind in GUARDED:
        both = F.lit(False)
        for wire, name in NAMES[kind].items():
            both = both | (F.array_contains("names", wire) & F.array_contains("names", name))
        heads = heads.filter(~both)
    # a row a file; what is the same for all of a file's lines is worked out here, and the lines are not dealt by file, which would put a large one into one task
    heads = counted(heads.select("file", "unset", "empty", F.size("names").alias("width"), _literal(F.col("separator")).alias("between"), _literal(F.col("set_separator")).alias("within"), *[(F.array_position("names", w) - 1).cast("int").alias(f"_at_{w}") for w in FIELDS[kind]]))
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).join(heads, "file").withColumn("cells", once(F.split("value", F.col("between"))))
    rows = rows.filter(F.size("cells") == F.col("width"))

    def cell(name: str, kind_: str) -> Column:
        raw = F.get("cells", F.col(f"`_at_{name}`"))
        raw = F.when(raw != F.col("unset"), raw)
        if kind_.startswith("array"):
            items = F.when(raw == F.col("empty"), F.array().cast("array<string>")).otherwise(F.split(raw, F.col("within")))
            return items if kind_ == "array<string>" else F.transform(items, lambda x: x.try_cast("double"))
        raw = F.when(raw == F.col("empty"), F.lit("")).otherwise(raw)
        if kind_ == "boolean":
            return F.when(raw.isin("T", "true"), True).when(raw.isin("F", "false"), False)
        return raw if kind_ == "string" else raw.try_cast(kind_)

    return rows.select(*[cell(w, t).alias(w) for w, t in FIELDS[kind].items()])


def _named(fields: DataFrame, kind: str) -> DataFrame:
    return fields.select(*[F.col(f"`{w}`").alias(NAMES.get(kind, {}).get(w, w)) for w in FIELDS[kind]])


def dns_lane(fields: DataFrame) -> DataFrame:
    """Internet-class rows only: another class, or none, goes."""
    return usable_ts(conform(_named(fields, "dns").filter("qclass = 1").drop("qclass"), "dns"))


def ssl_lane(fields: DataFrame) -> DataFrame:
    """cert_fp is the first certificate of the chain, null for an empty one."""
    leaf = F.nullif(F.get("cert_chain_fps", F.lit(0)), F.lit(""))
    return usable_ts(conform(_named(fields, "ssl").withColumn("cert_fp", leaf).drop("cert_chain_fps"), "ssl"))


def x509_lane(fields: DataFrame) -> DataFrame:
    """self_signed compares subject and issuer where both are there, else it is null."""
    named = _named(fields, "x509")
    own = F.col("`certificate.subject`") == F.col("`certificate.issuer`")
    return usable_ts(conform(named.withColumn("self_signed", own).drop("certificate.subject", "certificate.issuer"), "x509"))


def weird_lane(fields: DataFrame) -> DataFrame:
    return usable_ts(conform(_named(fields, "weird"), "weird"))


_STAMP = r"^(?:<\d+>)?(?:[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}[T ]\S+) "


def syslog_lane(fields: DataFrame) -> DataFrame:
    """Text messages only; trailing line ends go. The host is the one in the message's header, else the sender's address."""
    raw = F.regexp_replace("message", r"[\r\n]+$", "")
    rows = fields.filter("message IS NOT NULL").select("ts", F.col("`id.orig_h`").alias("sender"), raw.alias("raw"), "facility", "severity")
    headed = F.col("raw").rlike(_STAMP)
    rest = F.regexp_replace("raw", _STAMP, "")
    host = F.when(headed, F.nullif(F.regexp_extract(rest, r"^(\S+) ", 1), F.lit("")))
    rows = rows.withColumn("host", F.coalesce(F.nullif(host, F.lit("unknown")), "sender", F.lit("unknown"))).withColumn("body", F.when(headed, F.regexp_replace(rest, r"^\S+ ", "")).otherwise(F.col("raw")))
    program = F.nullif(F.regexp_extract("body", r"^([A-Za-z0-9_./()-]+)(?:\[\d+\])?:", 1), F.lit(""))
    return usable_ts(conform(rows.select("ts", "host", F.coalesce(program, F.lit("unknown")).alias("program"), "raw", F.regexp_replace("body", r"\[\d+\]", "[*]").alias("message"), "facility", "severity"), "syslog"))


LANES = {"dns": dns_lane, "ssl": ssl_lane, "x509": x509_lane, "weird": weird_lane, "syslog": syslog_lane}


def lane(lines: DataFrame, kind: str, tsv: bool = False) -> DataFrame:
    """A lane from (file, value) lines of one kind of log."""
    return LANES[kind]((tsv_fields if tsv else json_fields)(lines, kind))


def guarded(source: DataFrame, kind: str) -> DataFrame:
    """A source that is a table already (columns in wire names): its fields, or none of its rows where two names collide."""
    if collides(kind, source.columns):
        return source.sparkSession.createDataFrame([], schema(kind))
    there = {w: (F.col(f"`{w}`") if w in source.columns else F.lit(None)).cast(t).alias(w) for w, t in FIELDS[kind].items()}
    return LANES[kind](source.select(*there.values()))


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Several feeds of one lane together; a column that a feed lacks is null there."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out
