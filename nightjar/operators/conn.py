"""Flow operators: suppression, eligibility funnels, outbound transfers, scans, periodic call-outs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.frames import checkpointed, counted
from nightjar.functions.net import HOME_NET, classify_addresses, distinct_addresses, in_network, with_dimension
from nightjar.operators.windows import mix, most_distinct_in_range

SCAN_STATES = ("S0", "REJ", "RSTO", "RSTR", "SH", "OTH")
BEACON_STATES = ("SF", "S1")
IOT_MULTICAST = ("224.", "239.", "255.255.255.255", "ff0", "ff1", "ff2")
GIB = 1 << 30


class FlowRule(NamedTuple):
    """A hand-written rule: up to two addresses (exact, network or '*'), a port, a protocol, and the detectors that it is for (all if none)."""

    one: str | None = None
    other: str | None = None
    port: int | None = None
    proto: str | None = None
    detectors: tuple[str, ...] = ()


def _named_by(spec: str) -> F.Column:
    """Whether a row of the address dimension is what a rule names: any, a network, or that very text."""
    if spec == "*":
        return F.lit(True)
    if "/" not in spec:
        return F.col("address") == spec
    try:
        return in_network(spec)
    except ValueError:
        return F.lit(False)


def _matched(conn: DataFrame, rules: Iterable[FlowRule], detector: str | None) -> DataFrame:
    """conn with `_hit`. Every distinct address gets the list of the rule sides that name it; rows compare two short lists."""
    rules = [r for r in rules if not r.detectors or detector in r.detectors]
    sides = sorted({spec for r in rules for spec in (r.one, r.other) if spec is not None and spec != "*"})
    place = {spec: i for i, spec in enumerate(sides)}
    listed = F.array_compact(F.array(*[F.when(_named_by(spec), F.lit(i)) for spec, i in place.items()])) if sides else F.array().cast("array<int>")
    dimension = counted(distinct_addresses(conn, ["src", "dst"]).withColumn("sides", listed.cast("array<int>")))
    rows = conn
    for c in ("src", "dst"):
        rows = with_dimension(rows, dimension, c, ["sides"], f"_{c}")
        rows = rows.withColumn(f"_{c}", F.coalesce(F.col(f"_{c}.sides"), F.array().cast("array<int>")))
    at = lambda c, spec: F.lit(True) if spec == "*" else F.array_contains(f"_{c}", place[spec])
    hit = F.lit(False)
    for r in rules:
        own = F.lit(True)
        if r.one is not None and r.other is not None:
            own = (at("src", r.one) & at("dst", r.other)) | (at("src", r.other) & at("dst", r.one))
        elif r.one is not None or r.other is not None:
            spec = r.one if r.one is not None else r.other
            own = at("src", spec) | at("dst", spec)
        if r.port is not None:
            own = own & (F.col("port") == r.port)
        if r.proto is not None:
            own = own & (F.col("proto") == r.proto)
        hit = hit | F.coalesce(own, F.lit(False))
    return rows.withColumn("_hit", hit)


def suppress_flows(conn: DataFrame, rules: Iterable[FlowRule], detector: str | None = None) -> DataFrame:
    """Rows that no rule matches. A rule's two addresses match in either direction, one address on either side."""
    return _matched(conn, rules, detector).filter("NOT _hit").drop("_src", "_dst", "_hit")


def suppression_counts(conn: DataFrame, rules: Iterable[FlowRule], detector: str | None = None) -> DataFrame:
    """One row: rows that the rules match, and their distinct sources."""
    return _matched(conn, rules, detector).filter("_hit").agg(F.count("*").alias("rows"), F.countDistinct("src").alias("sources"))


def effective_local(conn: DataFrame, home_net: Iterable[str] = HOME_NET) -> DataFrame:
    """Adds src_facts, dst_facts and effective_local: local_orig where set, else whether src is at home."""
    faced = classify_addresses(conn, ["src", "dst"], home_net)
    return faced.withColumn("effective_local", F.coalesce("local_orig", "src_facts.local", F.lit(False)))


def beacon_funnel(conn: DataFrame, home_net: Iterable[str] = HOME_NET) -> DataFrame:
    """One row of counts after each gate of beacon eligibility, in one pass."""
    rows = effective_local(conn, home_net)
    gates = _beacon_gates()
    steps, so_far = [F.count("*").alias("rows_total")], F.lit(True)
    for name, gate in gates.items():
        so_far = so_far & gate
        steps.append(F.count_if(so_far).alias(name))
    return rows.agg(*steps)


def _beacon_gates() -> dict[str, F.Column]:
    fits = lambda c: ~F.coalesce(F.col(f"{c}_facts.non_routable"), F.lit(False))
    return {
        "after_state": F.coalesce(F.col("conn_state").isin(*BEACON_STATES), F.lit(False)),
        "after_unicast": fits("dst") & fits("src"),
        "after_local": F.col("effective_local"),
        "after_bytes": F.col("bytes").isNotNull(),
        "after_keys": F.col("src").isNotNull() & F.col("dst").isNotNull() & F.col("port").isNotNull() & F.col("proto").isNotNull(),
    }


def beacon_eligible(conn: DataFrame, home_net: Iterable[str] = HOME_NET) -> DataFrame:
    rows = effective_local(conn, home_net)
    for gate in _beacon_gates().values():
        rows = rows.filter(gate)
    return rows.drop("src_facts", "dst_facts", "effective_local")


def flow_group(conn: DataFrame, floor: int = 20) -> DataFrame:
    """Flows (src, dst, port, proto) with at least `floor` rows: count, bounds, mean bytes."""
    flows = conn.groupBy("src", "dst", "port", "proto").agg(F.count("*").alias("connections"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("bytes").alias("mean_bytes"))
    return flows.filter(F.col("connections") >= floor)


def beacon_score(conn: DataFrame, floor: int = 20, bin_s: float = 30.0, band: tuple[float, float] = (45.0, 7200.0), most_bins: int = 5_000_000) -> DataFrame:
    """Periodicity of each flow: period, spectral and jitter parts, score 0.4 ratio + 0.4 prominence + 0.2 regularity.

    Bins and gaps are aggregated by Spark; only a flow's (bin, count) table reaches a Python worker, for the FFT.
    Flows under 10 rows, without variance or over `most_bins` bins have no score.
    """
    flows = flow_group(conn, floor)
    keys = ["src", "dst", "port", "proto"]
    kept = conn.join(flows.select(*keys, "first_ts"), keys)
    order = Window.partitionBy(*keys).orderBy("ts", "row_id")
    gaps = kept.withColumn("gap", F.col("ts") - F.lag("ts").over(order)).filter("gap IS NOT NULL")
    centre = gaps.groupBy(*keys).agg(F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    clean = gaps.join(centre, keys).filter((F.abs(F.col("gap") - F.col("m")) < 3 * F.col("s")) | (F.col("s") == 0))
    jitter = clean.groupBy(*keys).agg((F.stddev_pop("gap") / F.avg("gap")).alias("jitter_cv"))
    bins = kept.groupBy(*keys, F.floor((F.col("ts") - F.col("first_ts")) / bin_s).cast("long").alias("bin")).agg(F.count("*").alias("n"))

    def spectrum(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["bin"].max()) + 1
        if part["n"].sum() < 10 or size > most_bins or size < 4:
            return pd.DataFrame([], columns=out)
        signal = np.zeros(size)
        signal[part["bin"].to_numpy()] = part["n"].to_numpy()
        strength = np.abs(np.fft.rfft(signal - signal.mean()))
        strength[0] = 0
        with np.errstate(divide="ignore"):
            period = 1 / np.fft.rfftfreq(size, bin_s)
        inside = np.flatnonzero((period >= band[0]) & (period <= band[1]))
        if not len(inside) or strength[inside].max() <= 0:
            return pd.DataFrame([], columns=out)
        at = int(inside[np.argmax(strength[inside])])
        reach = max(10, at // 20)
        # the neighbours of the peak on both sides, without the constant term
        near = np.r_[strength[max(1, at - reach) : at], strength[at + 1 : at + 1 + reach]]
        noise = np.median(near) if len(near) else 1.0
        return pd.DataFrame([(*key, period[at], strength[at] / strength.sum(), strength[at] / (noise + 1e-10))], columns=out)

    out = [*keys, "period", "ratio", "prominence"]
    found = bins.groupBy(*keys).applyInPandas(spectrum, "src string, dst string, port int, proto string, period double, ratio double, prominence double")
    scored = flows.join(found, keys).join(jitter, keys, "left")
    regular = F.greatest(F.lit(0.0), 1 - F.coalesce("jitter_cv", F.lit(1.0)))
    score = 0.4 * F.least(F.lit(1.0), "ratio") + 0.4 * F.least(F.lit(1.0), F.col("prominence") / 100) + 0.2 * regular
    return scored.select(*keys, "connections", F.round("period", 1).alias("period"), F.bround(score, 4).alias("score"), F.bround("jitter_cv", 4).alias("jitter_cv"), F.bround((F.col("last_ts") - F.col("first_ts")) / F.col("period"), 1).alias("cycles"))


def exfil_funnel(conn: DataFrame, home_net: Iterable[str] = HOME_NET) -> DataFrame:
    """One row of counts after each gate of outbound-transfer eligibility."""
    rows = effective_local(conn, home_net)
    steps, so_far = [F.count("*").alias("rows_total")], F.lit(True)
    for name, gate in _exfil_gates().items():
        so_far = so_far & gate
        steps.append(F.count_if(so_far).alias(name))
    return rows.agg(*steps)


def _exfil_gates() -> dict[str, F.Column]:
    no = F.lit(False)
    return {
        "after_parse": F.coalesce(F.col("src_facts.parsed") & F.col("dst_facts.parsed"), no),
        "after_local": F.col("effective_local"),
        "after_external": F.coalesce(F.col("dst_facts.external"), no),
        "after_bytes": F.coalesce((F.col("bytes") >= 0) & (F.col("resp_bytes") >= 0), no),
    }


def _exfil_rows(conn: DataFrame, home_net: Iterable[str], complete: bool = True) -> DataFrame:
    rows = effective_local(conn, home_net)
    for name, gate in _exfil_gates().items():
        if complete or name != "after_bytes":
            rows = rows.filter(gate)
    return rows.drop("src_facts", "dst_facts", "effective_local")


def exfil_pairs(conn: DataFrame, min_bytes: int = GIB, min_share: float = 0.6, home_net: Iterable[str] = HOME_NET, services: bool = True) -> DataFrame:
    """Local -> external pairs with much and mostly outbound traffic over rows with both byte counters; their services only if asked for, as these take a second pass."""
    rows = _exfil_rows(conn, home_net).withColumn("_both", F.col("bytes") + F.col("resp_bytes"))
    pairs = rows.groupBy("src", "dst").agg(
        F.sum("bytes").alias("orig_bytes"), F.sum("resp_bytes").alias("resp_bytes"), F.count("*").alias("connections"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("duration").alias("max_duration"),
    )
    share = F.col("orig_bytes") / (F.col("orig_bytes") + F.col("resp_bytes"))
    pairs = pairs.withColumn("share", share).filter((F.col("orig_bytes") >= min_bytes) & (F.col("share") >= min_share))
    if not services:
        return pairs.withColumn("orig_share", F.bround("share", 4)).drop("share")
    used = rows.join(pairs.select("src", "dst"), ["src", "dst"], "left_semi").withColumn("service", F.concat_ws("/", F.coalesce(F.col("port").cast("string"), F.lit("?")), F.coalesce("proto", F.lit("?"))))
    mixed = mix(used, ["src", "dst"], "service", "service_mix", F.col("_both"))
    return pairs.join(mixed, ["src", "dst"], "left").withColumn("orig_share", F.bround("share", 4)).drop("share")


def exfil_pools(pairs: DataFrame, least: int = 4, v4_bits: int = 20, v6_bits: int = 40) -> DataFrame:
    """Surfaced pairs of one source folded where at least `least` destinations share a network; the rest stay alone.

    Members are listed as text, at most a network's surfaced destinations of one source.
    """
    pairs = checkpointed(pairs)  # looked at three times
    found = counted(distinct_addresses(pairs, ["dst"]))
    dotted = F.concat_ws(".", *[F.shiftright(F.shiftleft(F.shiftright("number", 32 - v4_bits), 32 - v4_bits), 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])
    # an IPv6 network ends on a hex digit, so v6_bits is a multiple of 4
    kept = F.rpad(F.substring("wide", 1, v6_bits // 4), 32, "0")
    colons = F.concat_ws(":", *[F.substring(kept, 4 * i + 1, 4) for i in range(8)])
    net = F.when(F.col("version") == 4, F.concat(dotted, F.lit(f"/{v4_bits}"))).when(F.col("version") == 6, F.concat(colons, F.lit(f"/{v6_bits}")))
    keyed = pairs.join(found.select(F.col("address").alias("dst"), net.alias("net")), "dst", "left")
    pools = keyed.filter("net IS NOT NULL").groupBy("src", "net").agg(
        F.count("*").alias("destinations"), F.sum("orig_bytes").alias("orig_bytes"), F.sum("resp_bytes").alias("resp_bytes"), F.sum("connections").alias("connections"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("members"),
    ).filter(F.col("destinations") >= least)
    alone = keyed.join(pools.select("src", "net"), ["src", "net"], "left_anti").withColumns({"destinations": F.lit(1).cast("long"), "members": F.col("dst")})
    shape = lambda df, tier, name: df.select("src", F.col(name).alias("target"), F.lit(tier).alias("tier"), "destinations", "orig_bytes", "resp_bytes", "connections", "first_ts", "last_ts", "members")
    return shape(pools, "destination_pool", "net").unionByName(shape(alone, "pair", "dst"))


def exfil_partial_facts(conn: DataFrame, min_bytes: int = GIB, min_share: float = 0.6, home_net: Iterable[str] = HOME_NET) -> DataFrame:
    """Pairs with rows that lack the responder's bytes: what was measured, what was left out, and whether it could surface."""
    rows = _exfil_rows(conn, home_net, complete=False).filter("bytes >= 0")
    whole = F.coalesce(F.col("resp_bytes") >= 0, F.lit(False))
    facts = rows.groupBy("src", "dst").agg(
        F.count_if(whole).alias("complete_rows"), F.count_if(~whole).alias("excluded_rows"), F.sum(F.when(whole, F.col("bytes")).otherwise(0)).alias("eligible_bytes"),
        F.sum(F.when(~whole, F.col("bytes")).otherwise(0)).alias("excluded_bytes"), F.sum(F.when(whole, F.col("resp_bytes")).otherwise(0)).alias("resp_bytes"),
    ).filter("excluded_rows > 0")
    best = F.col("eligible_bytes") + F.col("excluded_bytes")
    could = (best >= min_bytes) & (best / (best + F.col("resp_bytes")) >= min_share)
    return facts.withColumn("could_surface", F.coalesce(could, F.lit(False)))


def scan_rows(conn: DataFrame) -> DataFrame:
    """Rows that scans are looked for in: keys and times there, no icmp, link-local or discovery multicast."""
    out = conn.withColumns({c: F.coalesce(c, F.lit("")) for c in ("src", "dst", "proto", "conn_state")})
    skipped = "^(?:" + "|".join(re.escape(p) for p in ("fe80:", *IOT_MULTICAST)) + ")"
    fits = F.col("ts").isNotNull() & (F.lower("proto") != "icmp") & ~F.col("dst").rlike(skipped) & ~F.col("src").startswith("fe80:")
    return out.filter(fits).withColumn("is_scan", F.col("conn_state").isin(*SCAN_STATES))


def scan_vertical(conn: DataFrame, span: float = 3600.0, least: int = 15) -> DataFrame:
    """(src, dst) with at least `least` distinct ports within any `span` seconds."""
    rows = scan_rows(conn).filter("port IS NOT NULL")
    return _scan(rows, ["src", "dst"], "port", span, least, "distinct_ports")


def scan_horizontal(conn: DataFrame, span: float = 3600.0, least: int = 15) -> DataFrame:
    """(src, port) with at least `least` distinct hosts within any `span` seconds."""
    rows = scan_rows(conn).filter("port IS NOT NULL")
    return _scan(rows, ["src", "port"], "dst", span, least, "distinct_hosts")


def _scan(rows: DataFrame, keys: list[str], value: str, span: float, least: int, name: str) -> DataFrame:
    # only keys with enough distinct values at all are swept
    candidates = rows.groupBy(*keys).agg(F.countDistinct(value).alias("_n"), F.avg(F.col("is_scan").cast("double")).alias("state_ratio"), F.count("*").alias("connections")).filter(F.col("_n") >= least)
    widest = most_distinct_in_range(rows.join(candidates.select(*keys), keys, "left_semi"), keys, value, "ts", span, name)
    return widest.filter(F.col(name) >= least).join(candidates.drop("_n"), keys).withColumn("state_ratio", F.bround("state_ratio", 3))


def scan_block(conn: DataFrame, span: float = 3600.0, ports: int = 20, hosts: int = 20, share: float = 0.3) -> DataFrame:
    """Sources that touch many ports and hosts in one time bucket, mostly unanswered: the broadest bucket of each."""
    rows = scan_rows(conn).filter("port IS NOT NULL").withColumn("bucket", F.floor(F.col("ts") / span).cast("long"))
    scan = F.avg(F.col("is_scan").cast("double"))
    whole = rows.groupBy("src").agg(F.countDistinct("port").alias("p"), F.countDistinct("dst").alias("h"), scan.alias("r")).filter((F.col("p") >= ports) & (F.col("h") >= hosts) & (F.col("r") >= share))
    each = rows.join(whole.select("src"), "src", "left_semi").groupBy("src", "bucket").agg(
        F.countDistinct("port").alias("distinct_ports"), F.countDistinct("dst").alias("distinct_hosts"), F.count("*").alias("connections"), scan.alias("r"), F.min("ts").alias("first_ts"),
        F.count_if(F.col("port") <= 1023).alias("well_known"),
    )
    each = each.filter((F.col("distinct_ports") >= ports) & (F.col("distinct_hosts") >= hosts) & (F.col("r") >= share))
    best = Window.partitionBy("src").orderBy(F.desc(F.col("distinct_ports") * F.col("distinct_hosts")), "bucket")
    return each.withColumn("_r", F.row_number().over(best)).filter("_r = 1").withColumn("state_ratio", F.bround("r", 3)).drop("_r", "r")


def scan_slow(conn: DataFrame, span: float = 3600.0, buckets: int = 4, ports: int = 8, fast: int = 15, share: float = 0.3) -> DataFrame:
    """Sources that touch many ports over several buckets, never many in one: spread = active buckets x ports."""
    rows = scan_rows(conn).filter("port IS NOT NULL").withColumn("bucket", F.floor(F.col("ts") / span).cast("long"))
    each = rows.groupBy("src", "bucket").agg(F.countDistinct("port").alias("ports"))
    spread = each.groupBy("src").agg(F.count("*").alias("active_buckets"), F.max("ports").alias("most_in_bucket"))
    whole = rows.groupBy("src").agg(F.countDistinct("port").alias("distinct_ports"), F.countDistinct("dst").alias("distinct_hosts"), F.avg(F.col("is_scan").cast("double")).alias("r"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    out = whole.join(spread, "src").filter((F.col("active_buckets") >= buckets) & (F.col("distinct_ports") >= ports) & (F.col("most_in_bucket") < fast) & (F.col("r") >= share))
    return out.join(mix(rows, ["src"], "port", "top_ports"), "src", "left").withColumn("state_ratio", F.bround("r", 3)).drop("r")


def finding(df: DataFrame, detector: str, severity: F.Column | str, title: F.Column, evidence: list[str]) -> DataFrame:
    """Rows in the common result shape: detector, severity, severity_rank, title, evidence (JSON)."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    rank = F.when(level == "HIGH", 0).when(level == "MEDIUM", 1).when(level == "LOW", 2).otherwise(3)
    return df.select(F.lit(detector).alias("detector"), level.alias("severity"), rank.alias("severity_rank"), title.alias("title"), F.to_json(F.struct(*evidence)).alias("evidence"))
