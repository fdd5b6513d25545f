"""The common result shape, its order and caps, short evidence, run notes, and the classes of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEVERITIES = ("HIGH", "MEDIUM", "LOW", "INFO")


def _literal_map(values: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])


def finding(df: DataFrame, detector: str, severity: Column | str, title: Column, evidence: list[str], *, description: Column | str = "", next_steps: Column | list[str] = (), window: tuple[float, float] | None = None, generated: float = 0.0) -> DataFrame:
    """Rows in the result shape: detector, severity, severity_rank, title, description, evidence (JSON), next_steps, ts_generated, window_start, window_end."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    rank = F.coalesce(*[F.when(level == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
    steps = next_steps if isinstance(next_steps, Column) else F.array(*[F.lit(s) for s in next_steps]).cast("array<string>")
    lo, hi = window or (None, None)
    return df.select(
        F.lit(detector).alias("detector"), level.alias("severity"), rank.alias("severity_rank"), title.alias("title"), (F.lit(description) if isinstance(description, str) else description).alias("description"),
        F.to_json(F.struct(*evidence)).alias("evidence"), steps.alias("next_steps"), F.lit(generated).alias("ts_generated"), F.lit(lo).cast("double").alias("window_start"), F.lit(hi).cast("double").alias("window_end"),
    )


# Ports of discovery, peer-to-peer and unassigned traffic.
DISCOVERY_PORTS, PEER_PORTS, TRACKER_PORTS, DARK_PORTS = (137, 138, 1900, 5353, 5355, 3702), tuple(range(6881, 6890)) + (51413,), (6969, 1337, 2710), (0, 1)


def classify_scans(scans: DataFrame) -> DataFrame:
    """The broadest row of each (scan_type, src, dst, port), with its tag and severity.

    scans: scan_type, src, dst, port, distinct_ports, distinct_hosts, state_ratio. The first fitting tag counts.
    """
    ports, hosts = F.coalesce("distinct_ports", F.lit(0)), F.coalesce("distinct_hosts", F.lit(0))
    breadth = F.greatest(ports, hosts)
    first = Window.partitionBy("scan_type", "src", "dst", "port").orderBy(F.desc(breadth), F.desc("state_ratio"))
    rows = scans.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    port, ratio, kind = F.col("port"), F.col("state_ratio"), F.col("scan_type")
    many = hosts >= 15
    tag = (
        F.when(kind == "slow", "slow_scan").when(port.isin(*DISCOVERY_PORTS) & (ratio < 0.4), "iot_discovery").when(port.isin(*PEER_PORTS) & (ratio >= 0.5), "bittorrent").when(port.isin(*TRACKER_PORTS) & (ratio >= 0.15), "bittorrent")
        .when((port == 53) & (ratio < 0.05) & many, "dns_resolver").when((port == 443) & (ratio < 0.1) & many, "https_browsing").when((port == 80) & (ratio < 0.1) & many, "http_browsing")
        .when((port == 443) & (ratio < 0.5) & (hosts >= 20), "streaming_blocked").when(port.isin(*DARK_PORTS) & (ratio >= 0.9), "dark_traffic").when(ratio >= 0.6, "confirmed_scan").otherwise("unknown")
    )
    tagged = rows.withColumn("tag", F.coalesce(tag, F.lit("unknown")))
    harmless = F.col("tag").isin("dns_resolver", "https_browsing", "http_browsing", "iot_discovery", "dark_traffic")
    severity = (
        F.when(harmless, "LOW").when(F.col("tag") == "slow_scan", F.when(ratio >= 0.6, "HIGH").otherwise("MEDIUM")).when(ratio >= 0.6, "HIGH").when((ratio >= 0.3) & (breadth >= 50), "HIGH")
        .when(ratio >= 0.2, "MEDIUM").when((ratio >= 0.1) & (breadth >= 25), "MEDIUM").otherwise("LOW")
    )
    return tagged.withColumn("severity", severity)


def rank_and_cap(findings: DataFrame, cap: int = 20, sections: tuple[str, ...] = (), always: Column | None = None) -> DataFrame:
    """Findings with place and remainder: by severity within a detector's section, one cap a detector spent section by section.

    findings has detector, section, severity_rank, title. Rows that are always shown have place 0 and don't count. remainder is how
    many of the detector's rows were left out. The rows of a detector are ranked by counts a section and severity, then row by row
    only within the cell that the cap falls into.
    """
    shown = always if always is not None else F.lit(False)
    order = F.coalesce(*[F.when(F.col("section") == s, F.lit(i)) for i, s in enumerate(sections)], F.lit(len(sections))) if sections else F.lit(0)
    rows = findings.withColumns({"_shown": shown, "_section": order})
    cells = rows.filter("NOT _shown").groupBy("detector", "_section", "severity_rank").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("detector").orderBy("_section", "severity_rank")  # a few cells a detector
    placed = cells.withColumn("_before", F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("detector")))
    kept = placed.filter(F.col("_before") < cap).select("detector", "_section", "severity_rank", "_before", "_all")
    inside = rows.filter("NOT _shown").join(F.broadcast(kept), ["detector", "_section", "severity_rank"])  # at most `cap` cells a detector
    nth = F.row_number().over(Window.partitionBy("detector", "_section", "severity_rank").orderBy("title", "evidence"))
    ranked = inside.withColumn("place", (F.col("_before") + nth).cast("long")).filter(F.col("place") <= cap).withColumn("remainder", F.greatest(F.col("_all") - cap, F.lit(0)))
    names = [*findings.columns, "place", "remainder"]
    return ranked.select(*names).unionByName(rows.filter("_shown").withColumns({"place": F.lit(0).cast("long"), "remainder": F.lit(0).cast("long")}).select(*names))


def curated(findings: DataFrame, fields: dict[str, list[str]], longest: int = 12) -> DataFrame:
    """findings with `signals`: a detector's chosen evidence fields as `name=value`, without empty ones; lists cut to `longest` values, with how many more."""
    chosen = _literal_map(fields)
    held = F.from_json("evidence", "map<string,string>")

    def short(name: Column) -> Column:
        value = F.get(F.transform(F.array(name), lambda n: F.col("_e").getItem(n)), F.lit(0))
        items = F.from_json(value, "array<string>")
        more = F.when(F.size(items) > longest, F.concat(F.lit(" +"), (F.size(items) - longest).cast("string"))).otherwise("")
        listed = F.concat(F.array_join(F.slice(items, 1, longest), ", "), more)
        return F.when(value.rlike(r"^\["), F.nullif(listed, F.lit(""))).otherwise(F.nullif(value, F.lit("")))

    rows = findings.withColumn("_e", held).withColumn("_names", F.coalesce(F.element_at(chosen, F.col("detector")), F.array().cast("array<string>")))
    parts = F.transform("_names", lambda n: F.when(short(n).isNotNull(), F.concat(n, F.lit("="), short(n))))
    return rows.withColumn("signals", F.array_compact(parts)).drop("_e", "_names")


def run_notes(funnel: DataFrame, detector: str, gates: list[str], span_days: Column | None = None, thin_days: float = 7.0, least: int = 1000) -> DataFrame:
    """(detector, code, n, text) from a funnel's one row of counts: what each gate left out, and a thin span.

    A gate that drops half or more of at least `least` rows is named with its share.
    """
    before = [F.col(g) for g in gates[:-1]]
    after = [F.col(g) for g in gates[1:]]
    notes = []
    for name, b, a in zip(gates[1:], before, after, strict=True):
        lost = b - a
        heavy = (b >= least) & (lost >= 0.5 * b)
        text = F.when(heavy, F.format_string(f"{name}: %d of %d rows left out (%.0f%%)", lost.cast("long"), b.cast("long"), 100.0 * lost / b)).otherwise(F.format_string(f"{name}: %d rows left out", lost.cast("long")))
        notes.append(F.when(lost > 0, F.struct(F.lit(name).alias("code"), lost.cast("long").alias("n"), text.alias("text"))))
    if span_days is not None:
        notes.append(F.when(span_days < thin_days, F.struct(F.lit("thin_span").alias("code"), F.floor(span_days).cast("long").alias("n"), F.format_string("the data span %.1f days", span_days).alias("text"))))
    return funnel.select(F.explode(F.array_compact(F.array(*notes))).alias("note")).select(F.lit(detector).alias("detector"), "note.code", "note.n", "note.text")
