"""Text logs to lanes. Every parser takes a frame of (file, value) lines, so files and derived lines parse alike."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nightjar.functions.frames import counted, once
from nightjar.lanes import conform

# Wire names of connection and DNS logs and their lane names and types.
CONN_WIRE = {"id.orig_h": "src", "id.resp_h": "dst", "id.resp_p": "port", "proto": "proto", "ts": "ts", "orig_bytes": "bytes", "resp_bytes": "resp_bytes", "duration": "duration", "conn_state": "conn_state", "local_orig": "local_orig"}
DNS_WIRE = {"ts": "ts", "id.orig_h": "src", "query": "query", "id.resp_h": "resolver", "qtype": "qtype", "rtt": "rtt", "TTLs": "ttl", "rcode": "rcode", "answers": "answer", "TC": "tc", "qclass": "qclass"}
TYPES = {"ts": "double", "id.resp_p": "int", "orig_bytes": "long", "resp_bytes": "long", "duration": "double", "local_orig": "boolean", "qtype": "int", "rtt": "double", "TTLs": "array<double>", "rcode": "int", "answers": "array<string>", "TC": "boolean", "qclass": "int"}
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def read_lines(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> DataFrame:
    """(file, value) of text files at any depth; compressed files are read by their suffix."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")


def in_dates(paths: DataFrame, since: str, until: str, column: str = "file") -> DataFrame:
    """Rows whose path has no dated directory, or one (YYYY-MM-DD...) from `since` to `until`."""
    day = F.regexp_extract(column, r"/(\d{4}-\d{2}-\d{2})[^/]*/", 1)
    return paths.filter((day == "") | day.between(since, until))


def usable_ts(df: DataFrame, since: float | None = None, until: float | None = None, keep_null: bool = False) -> DataFrame:
    """Rows with a finite time within the closed window; null times go unless they are kept through it."""
    ts = F.col("ts")
    fits = ts.between(0.0, 253_402_300_799.0)
    if since is not None:
        fits = fits & (ts >= since)
    if until is not None:
        fits = fits & (ts <= until)
    return df.filter(F.coalesce(fits, F.lit(keep_null)) | (ts.isNull() if keep_null else F.lit(False)))


def zeek_ndjson(lines: DataFrame, wire: dict[str, str], lane: str) -> DataFrame:
    """JSON objects, one a line; comments, malformed lines, non-objects and rows without a time go."""
    schema = T.StructType([T.StructField(w, T._parse_datatype_string(TYPES.get(w, "string"))) for w in wire])
    parsed = lines.filter(~F.col("value").rlike(r"^\s*(#|$)") & F.col("value").rlike(r"^\s*\{")).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return usable_ts(conform(parsed.select(*[F.col("r").getField(w).alias(name) for w, name in wire.items()]), lane))


def zeek_tsv(lines: DataFrame, wire: dict[str, str], lane: str) -> DataFrame:
    """Tab-separated logs with a header of their own in each file: the header rows become a small dimension by file.

    Unset values become null, containers arrays. Lines with another number of fields than the header's go.
    """
    fields = lines.filter(F.col("value").startswith("#fields")).select("file", F.slice(F.split("value", "\t"), 2, 10_000).alias("names"))
    # a row a file, so that the lines are not dealt by file, which would put a large one into one task
    heads = fields.groupBy("file").agg(F.first("names").alias("names"))
    heads = counted(heads.select("file", F.size("names").alias("width"), *[(F.array_position("names", w) - 1).cast("int").alias(f"_at_{w}") for w in wire]))
    rows = lines.filter(~F.col("value").startswith("#") & (F.col("value") != "")).join(heads, "file").withColumn("cells", once(F.split("value", "\t")))
    rows = rows.filter(F.size("cells") == F.col("width"))

    def cell(name: str) -> Column:
        raw = F.get("cells", F.col(f"`_at_{name}`"))
        raw = F.when(~raw.isin("-", ""), raw)
        kind = TYPES.get(name, "string")
        if kind.startswith("array"):
            items = F.when(raw == "(empty)", F.array().cast("array<string>")).otherwise(F.split(raw, ","))
            return items if kind == "array<string>" else F.transform(items, lambda x: x.try_cast("double"))
        if kind == "boolean":
            return F.when(raw == "T", True).when(raw == "F", False)
        return raw if kind == "string" else raw.try_cast(kind)

    return usable_ts(conform(rows.select(*[cell(w).alias(name) for w, name in wire.items()]), lane))


def _month_day_time(text: Column, year: Column) -> Column:
    """'Jan  2 03:04:05' of a year as epoch seconds in UTC."""
    parts = F.split(text, r"\s+")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, F.lit(0)))
    time = F.split(F.get(parts, F.lit(2)), ":")
    date = F.try_to_timestamp(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0")), F.lit("yyyy-MM-dd"))
    return F.unix_seconds(date).cast("double") + time[0].try_cast("int") * 3600 + time[1].try_cast("int") * 60 + time[2].try_cast("int")


def _rfc3164(text: Column, as_of: float) -> Column:
    """The year is that of `as_of`, or the one before where that would be over seven days ahead."""
    year = F.year(F.timestamp_seconds(F.lit(as_of)))
    this = _month_day_time(text, year)
    return F.when(this > as_of + 7 * 86400, _month_day_time(text, year - 1)).otherwise(this)


_STAMP = r"^(?:<\d+>)?([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) "
_ISO = r"^(?:<\d+>)?(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?) "


def syslog_text(lines: DataFrame, as_of: float) -> DataFrame:
    """RFC 3164 and ISO-8601 lines: ts, host, program, raw, message with process ids masked; a line without a stamp keeps its text."""
    v = F.col("value")
    old, iso = F.regexp_extract(v, _STAMP, 1), F.regexp_extract(v, _ISO, 1)
    ts = F.when(old != "", _rfc3164(old, as_of)).when(iso != "", F.unix_micros(F.try_to_timestamp(iso)) / 1e6)
    rest = F.when(old != "", F.regexp_replace(v, _STAMP, "")).when(iso != "", F.regexp_replace(v, _ISO, ""))
    host = F.regexp_extract(rest, r"^(\S+) ", 1)
    body = F.regexp_replace(rest, r"^\S+ ", "")
    program = F.regexp_extract(body, r"^([A-Za-z0-9_./-]+)(?:\[\d+\])?:", 1)
    stem = F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)
    rows = lines.filter(F.trim("value") != "").select(
        ts.alias("ts"), F.coalesce(F.nullif(host, F.lit("")), F.nullif(stem, F.lit("")), F.lit("unknown")).alias("host"), F.coalesce(F.nullif(program, F.lit("")), F.lit("unknown")).alias("program"),
        v.alias("raw"), F.regexp_replace(F.coalesce(body, v), r"\[\d+\]", "[*]").alias("message"),
    )
    return usable_ts(conform(rows, "syslog"), keep_null=True)


# Resolver log grammars in order, first match wins: (event type, pattern, group of the name or 0 for none).
DNSMASQ = (
    ("query", r"query\[([^\]]+)\]\s+(\S+)\s+from\s+(\S+)", 2),
    ("dhcp", r"DHCP\s+\S+\s+is\s+\S+", 0),
    ("dnssec_query", r"dnssec-query\[([^\]]+)\]\s+(\S+)\s+to\s+\S+", 2),
    ("forwarded", r"forwarded\s+(\S+)\s+to\s+\S+", 1),
    ("reply", r"reply\s+(\S+)\s+is\s+.+$", 1),
    ("cached", r"cached(?:-stale)?\s+(\S+)\s+is\s+.+$", 1),
    ("gravity_blocked", r"gravity blocked (?:\([^)]+\)\s+)?(\S+) is .+$", 1),
    ("special", r"special domain\s+(\S+)\s+is\s+.+$", 1),
    ("pihole_hostname", r"Pi-hole hostname\s+(\S+)\s+is\s+.+$", 1),
    ("regex_blocked", r"(?:regex (?:denied|blacklisted)|exactly (?:denied|blacklisted)|blacklisted)\s+(\S+)\s+is\s+.+$", 1),
    ("config", r"(?:/\S+|config)\s+(\S+)\s+is\s+.+$", 1),
    ("validation", r"validation result is \S+", 0),
)
_RESOLVER = r"^\s*\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+(?:(\S+)\s+)?dnsmasq\[\d+\]:\s+(.+?)\s*$"


def dnsmasq_text(lines: DataFrame, as_of: float) -> DataFrame:
    """Resolver log lines: ts, src, query, event_type, qtype, host. A line of no grammar is `unknown`; the host of a line without one is its file's stem."""
    v = F.col("value")
    stem = F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)
    shaped = lines.filter(v.rlike(_RESOLVER)).select(v.alias("value"), F.coalesce(F.nullif(F.regexp_extract(v, _RESOLVER, 1), F.lit("")), stem).alias("host"), F.regexp_extract(v, _RESOLVER, 2).alias("body"))
    body = F.col("body")
    kind = name = qtype = F.lit(None).cast("string")
    for label, pattern, group in reversed(DNSMASQ):
        hit = body.rlike("^" + pattern)
        kind = F.when(hit, label).otherwise(kind)
        name = F.when(hit, F.regexp_extract(body, "^" + pattern, group) if group else None).otherwise(name)
        if group == 2:
            qtype = F.when(hit, F.regexp_extract(body, "^" + pattern, 1)).otherwise(qtype)
    asked = body.rlike("^" + DNSMASQ[0][1])
    rows = shaped.select(
        _rfc3164(F.regexp_extract(v, r"^\s*(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", 1), as_of).alias("ts"), F.when(asked, F.regexp_extract(body, DNSMASQ[0][1], 3)).alias("src"), F.lower(name).alias("query"), F.coalesce(kind, F.lit("unknown")).alias("event_type"), qtype.alias("qtype"), "host",
    )
    return usable_ts(conform(rows, "pihole"), keep_null=True)


def journal_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exported journal records, one JSON object a line: the syslog lane, and (reason, rows) of what was refused."""
    text = lambda key: F.get_json_object("value", f"$.{key}")
    raw = text("MESSAGE")
    decoded = F.decode(F.to_binary(F.array_join(F.transform(F.from_json(raw, "array<int>"), lambda b: F.lpad(F.hex(b), 2, "0")), ""), F.lit("hex")), "UTF-8")
    message = F.when(raw.rlike(r"^\[[\d, ]*\]$"), decoded).otherwise(raw)
    micros = text("__REALTIME_TIMESTAMP").try_cast("long")
    shape = F.get_json_object("value", "$").isNotNull() & F.col("value").rlike(r"^\s*\{")
    reason = F.when(~F.coalesce(shape, F.lit(False)), "malformed").when(micros.isNull(), "no_time").when(message.isNull(), "no_message")
    program = F.coalesce(text("SYSLOG_IDENTIFIER"), text("_COMM"), F.lit("unknown"))
    pid = F.coalesce(text("SYSLOG_PID"), text("_PID"))
    marked = lines.filter(F.trim("value") != "").select(
        reason.alias("reason"), (micros / 1e6).alias("ts"), F.coalesce(text("_HOSTNAME"), F.lit("unknown")).alias("host"), program.alias("program"), message.alias("raw"),
        F.concat(program, F.when(pid.isNotNull(), F.lit("[*]")).otherwise(F.lit("")), F.lit(": "), message).alias("message"),
    )
    kept = usable_ts(conform(marked.filter("reason IS NULL").drop("reason"), "syslog"))
    return kept, marked.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("rows"))


_EVENT = """eventTime string, eventSource string, eventName string, awsRegion string, sourceIPAddress string, errorCode string, readOnly boolean, eventID string,
userIdentity struct<type: string, arn: string, userName: string, principalId: string, invokedBy: string, accountId: string, sessionContext: struct<sessionIssuer: struct<arn: string, userName: string>>>"""
_READS = ("Get", "List", "Describe", "Head", "Lookup", "Search")


def cloudtrail_lane(events: DataFrame) -> DataFrame:
    """Raw events (one JSON text a row, column `raw`) with principal, lane and read_write derived."""
    e = F.col("e")
    who = e["userIdentity"]
    issuer = who["sessionContext"]["sessionIssuer"]
    last = lambda arn: F.element_at(F.split(arn, "/"), -1)
    principal = (
        F.when(who["type"] == "Root", F.lit("root")).when(who["type"] == "IAMUser", F.coalesce(who["userName"], last(who["arn"])))
        .when(who["type"].isin("AssumedRole", "FederatedUser"), F.coalesce(issuer["userName"], last(issuer["arn"]), last(who["arn"])))
        .when(who["type"] == "AWSService", who["invokedBy"]).otherwise(F.coalesce(who["userName"], who["principalId"], who["accountId"]))
    )
    linked = F.coalesce(F.exists(F.split(F.coalesce(issuer["arn"], who["arn"]), "/"), lambda p: p.startswith("AWSServiceRoleFor")), F.lit(False))
    service = (who["type"] == "AWSService") | who["invokedBy"].isNotNull() | linked
    verb = F.lit(False)
    for r in _READS:
        verb = verb | e["eventName"].startswith(r)
    access = F.when(e["readOnly"].isNotNull(), F.when(e["readOnly"], "read").otherwise("write")).when(e["eventName"].isNull(), "unknown").when(verb, "read").otherwise("write")
    rows = events.withColumn("e", F.from_json("raw", _EVENT)).select(
        (F.unix_micros(F.try_to_timestamp(e["eventTime"])) / 1e6).alias("ts"), e["eventSource"].alias("event_source"), e["eventName"].alias("event_name"), who["type"].alias("identity_type"), e["sourceIPAddress"].alias("source_ip"),
        e["errorCode"].alias("error_code"), e["awsRegion"].alias("aws_region"), e["eventID"].alias("event_id"), principal.alias("principal"), F.when(F.coalesce(service, F.lit(False)), "service").otherwise("interactive").alias("lane"), access.alias("read_write"), "raw",
    )
    return usable_ts(conform(rows, "cloudtrail"))


def cloudtrail_json(documents: DataFrame) -> DataFrame:
    """(file, value) documents: an envelope of Records, a JSON list, one object, or an object a line."""
    value = F.col("value")
    listed = F.when(value.rlike(r"^\s*\["), value).otherwise(F.get_json_object("value", "$.Records"))
    many = documents.filter(listed.isNotNull()).select(F.explode(F.from_json(listed, "array<string>")).alias("raw"))
    one = documents.filter(listed.isNull() & value.rlike(r"^\s*\{")).select(value.alias("raw"))
    return cloudtrail_lane(many.unionByName(one))


def route(lines: DataFrame, first: int = 200) -> DataFrame:
    """(file, lane): what each file's first lines look like, by ordered recognisers; `blob` if by nothing.

    A partition's lines of a file come in the file's order, so only the first ones of each partition are kept (`line heads`,
    at most ``first`` a file and partition) before they are ranked: no file is sorted whole.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            keep = []
            for file in batch["file"].to_pylist():
                seen[file] += 1
                keep.append(seen[file] <= first)
            yield batch.filter(pa.array(keep, pa.bool_()))

    numbered = lines.select("file", "value", F.monotonically_increasing_id().alias("_at")).mapInArrow(heads, "file string, value string, _at long")
    head = numbered.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("_at"))).filter(F.col("_n") <= first)
    v = F.col("value")
    votes = {
        "conn": v.rlike('"conn_state"|^#path\\s+conn$'), "dns": v.rlike('"qtype(?:_name)?"|^#path\\s+dns$'), "ssl": v.rlike('"server_name"|"cipher"|^#path\\s+ssl$'), "x509": v.rlike('"certificate\\.|^#path\\s+x509$'),
        "weird": v.rlike('"name".*"peer"|^#path\\s+weird$'), "cloudtrail": v.rlike('"eventSource"|"Records"\\s*:'), "pihole": v.rlike(r"dnsmasq(?:\[\d+\])?: "), "syslog": v.rlike(_STAMP) | v.rlike(_ISO),
    }
    seen = head.groupBy("file").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in votes.items()])
    lane = F.lit("blob")
    for name in reversed(votes):
        lane = F.when(F.col(name), name).otherwise(lane)
    return seen.select("file", lane.alias("lane"))


def write_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines; values that aren't finite become null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in findings.dtypes]
    findings.select(*clean).write.mode("error").json(path)


def write_worklist(findings: DataFrame, path: str) -> None:
    """A fixed-column CSV worklist; text that a spreadsheet would run as a formula is quoted."""
    safe = lambda c: F.when(F.col(c).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(F.col(c)).alias(c)
    findings.select(*[safe(c) for c in ("detector", "severity", "title", "evidence")], F.lit("").alias("status"), F.lit("").alias("notes")).write.mode("error").option("header", "true").csv(path)
