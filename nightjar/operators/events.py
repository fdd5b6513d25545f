"""System-log operators: rarity, bursts, families, anchored events and claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.operators.windows import gap_sessions, order_statistic

# What marks a reboot, a session's open and close, and a package update.
REBOOT = r"(?i)\b(?:linux version|system boot|rebooting|kernel: booting)\b"


def masked(message: Column) -> Column:
    """A message with hexadecimal runs, numbers and hex pairs masked: the first step of template mining."""
    text = F.regexp_replace(message, r"\b(?:[0-9a-fA-F]{2}:){3,}[0-9a-fA-F]{2}\b", "<HEXPAIRS>")
    text = F.regexp_replace(text, r"\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{12,}\b", "<HEX>")
    return F.regexp_replace(text, r"\b\d+\b", "<*>")


def template_rarity(rows: DataFrame, template: str = "template", pct: float = 5.0, most: int = 10) -> DataFrame:
    """Rows of templates whose count is at most the threshold: an order statistic of template counts, capped."""
    counts = rows.groupBy(template).agg(F.count("*").alias("template_count"))
    place = F.greatest(F.lit(0), F.floor(F.col("n") * pct / 100).cast("int") - 1)
    limit = order_statistic(counts.withColumn("_k", F.lit(0)), ["_k"], "template_count", place, "_limit").select(F.least("_limit", F.lit(most)).alias("threshold"))
    return rows.join(counts, template).crossJoin(F.broadcast(limit)).filter(F.col("template_count") <= F.col("threshold"))  # one row on the right


def burst_collapse(rows: DataFrame, gap: float = 60.0, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Bursts (sessions of at least `least` rows of a host) and the rows that are in none."""
    timed = gap_sessions(rows.filter("ts IS NOT NULL"), ["host"], "ts", gap, ["row_id"])
    sized = timed.withColumn("_n", F.count("*").over(Window.partitionBy("host", "session")))
    bursts = sized.filter(F.col("_n") >= least).groupBy("host", "session").agg(F.count("*").alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("program").alias("programs"))
    rest = sized.filter(F.col("_n") < least).drop("_n", "session").unionByName(rows.filter("ts IS NULL"))
    return bursts, rest


def family_fold(rare: DataFrame, everything: DataFrame, least: int = 4, samples: int = 20) -> DataFrame:
    """Rare rows per (host, program): a family of `least` or more, else singles; with the full population's rows."""
    key = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("host", "program")]
    total = everything.select(*key).groupBy("host", "program").agg(F.count("*").alias("population"))
    ordered = Window.partitionBy("host", "program").orderBy("ts", "row_id")
    few = rare.select(*key, "ts", "row_id", "message").withColumn("_r", F.row_number().over(ordered))
    # samples are cut before they are gathered, so no list outgrows its bound
    listed = F.array_sort(F.collect_list(F.when(F.col("_r") <= samples, F.struct("_r", "message"))))
    units = few.groupBy("host", "program").agg(F.count("*").alias("rare"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(F.transform(listed, lambda x: x["message"]), "\n").alias("sample"))
    return units.join(total, ["host", "program"], "left").withColumn("kind", F.when(F.col("rare") >= least, "family").otherwise("single"))


def anchored_events(rows: DataFrame, anchor: Column, gap: float, least: int = 1) -> DataFrame:
    """Runs of rows that match an anchor, per host: (host, event, anchors, start, end); rows without a time make one run."""
    hits = rows.filter(anchor)
    runs = gap_sessions(hits.filter("ts IS NOT NULL"), ["host"], "ts", gap, ["row_id"], "event")
    timed = runs.groupBy("host", "event").agg(F.count("*").alias("anchors"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    untimed = hits.filter("ts IS NULL").groupBy("host").agg(F.count("*").alias("anchors")).select("host", F.lit(0).cast("long").alias("event"), "anchors", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    return timed.unionByName(untimed).filter(F.col("anchors") >= least)


def admin_sessions(rows: DataFrame, opens: Column, closes: Column, gap: float = 2700.0, longest: float = 28_800.0) -> DataFrame:
    """Sessions from the first open to the last close at or after it, at most `longest` seconds."""
    marked = rows.filter("ts IS NOT NULL").withColumn("_o", opens).withColumn("_c", closes).filter("_o OR _c")
    runs = gap_sessions(marked, ["host"], "ts", gap, ["row_id"], "event")
    begun = runs.withColumn("_from", F.min(F.when(F.col("_o"), F.col("ts"))).over(Window.partitionBy("host", "event")))
    spans = begun.groupBy("host", "event").agg(F.min("_from").alias("start"), F.max(F.when(F.col("_c") & (F.col("ts") >= F.col("_from")), F.col("ts"))).alias("end"))
    return spans.filter((F.col("end") - F.col("start")) <= longest)


def outside_windows(anchors: DataFrame, windows: DataFrame, before: float, after: float, slot: float = 3600.0) -> DataFrame:
    """Anchors in no window [start - before, end + after] of their host.

    Both sides are keyed by time slots, so that the range join has an equality to be dealt by.
    """
    spans = windows.filter("start IS NOT NULL").select(F.col("host").alias("_h"), (F.col("start") - before).alias("_lo"), (F.col("end") + after).alias("_hi"))
    spans = spans.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_lo") / slot), F.floor(F.col("_hi") / slot))))
    return anchors.withColumn("_s", F.floor(F.col("ts") / slot)).join(spans, (F.col("host") == F.col("_h")) & (F.col("_s") == F.col("_slot")) & F.col("ts").between(F.col("_lo"), F.col("_hi")), "left_anti").drop("_s")


def claim_intervals(findings: DataFrame, events: DataFrame, before: float = 60.0, after: float = 120.0, least: int = 2, slot: float = 3600.0) -> DataFrame:
    """Findings that lie inside an event's window on their host, each claimed by the nearest event with enough members.

    findings: row_id, host, first_ts, last_ts. events: host, event, start, end. Ties go to the earlier event.
    """
    wide = events.filter("start IS NOT NULL").select(F.col("host").alias("_h"), "event", "start", (F.col("start") - before).alias("_lo"), (F.col("end") + after).alias("_hi"))
    wide = wide.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_lo") / slot), F.floor(F.col("_hi") / slot))))
    inside = (F.col("host") == F.col("_h")) & (F.floor(F.col("first_ts") / slot) == F.col("_slot")) & (F.col("first_ts") >= F.col("_lo")) & (F.col("last_ts") <= F.col("_hi"))
    nearest = Window.partitionBy("row_id").orderBy(F.abs(F.col("first_ts") - F.col("start")), "start", "event")
    claimed = findings.join(wide, inside).withColumn("_r", F.row_number().over(nearest)).filter("_r = 1")
    members = claimed.withColumn("_n", F.count("*").over(Window.partitionBy("host", "event")))
    return members.filter(F.col("_n") >= least).select("row_id", "host", "event", "start")


def match_boots(boots: DataFrame, bursts: DataFrame, gap: float = 60.0) -> DataFrame:
    """boots with the burst of their host that each one claims: (host, event, start, end, session, kind).

    boots: host, event, start, end. bursts: host, session, first_ts, last_ts. In order of start a boot takes the burst nearest by start
    (of equal ones the earlier) among those that its interval meets within ``gap`` and that no earlier boot took; each burst goes to one
    boot at most. A boot without one, or without a time, is standalone. Whatever can meet lies in one chain of intervals
    that are at most ``gap`` apart, so chains are taken one by one and a host's rows are never together.
    """
    timed = boots.filter("start IS NOT NULL").select("host", F.lit(True).alias("is_boot"), F.col("event").cast("long").alias("id"), "start", F.col("end").alias("stop"))
    both = timed.unionByName(bursts.select("host", F.lit(False).alias("is_boot"), F.col("session").cast("long").alias("id"), F.col("first_ts").alias("start"), F.col("last_ts").alias("stop")))
    order = Window.partitionBy("host").orderBy("start", "stop", "is_boot", "id")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = both.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1))
    chained = opened.withColumn("chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def claim(part: pd.DataFrame) -> pd.DataFrame:
        host, free, out = part["host"].iloc[0], [b for b in part[~part["is_boot"]].sort_values(["start", "id"]).itertuples()], []
        for boot in part[part["is_boot"]].sort_values(["start", "id"]).itertuples():
            meets = [b for b in free if boot.start <= b.stop + gap and b.start <= boot.stop + gap]
            nearest = min(meets, key=lambda b: (abs(b.start - boot.start), b.start, b.id), default=None)
            if nearest is not None:
                free.remove(nearest)
                out.append((host, boot.id, nearest.id))
        return pd.DataFrame(out, columns=["host", "id", "session"])

    mixed = chained.withColumn("_b", F.max("is_boot").over(Window.partitionBy("host", "chain"))).filter("_b").select("host", "chain", "is_boot", "id", "start", "stop")
    claims = mixed.groupBy("host", "chain").applyInPandas(claim, "host string, id long, session long")
    found = boots.join(claims.select("host", F.col("id").alias("event"), "session"), ["host", "event"], "left")
    return found.select("host", "event", "start", "end", "session", F.when(F.col("session").isNull(), "standalone").otherwise("labelled").alias("kind"))


def transaction_units(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Claimed members folded per event: lines, programs, bounds."""
    joined = claims.select("row_id", "host", "event").join(rows.drop("host"), "row_id")
    return joined.groupBy("host", "event").agg(F.count("*").alias("lines"), F.countDistinct("program").alias("programs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
