"""Cloud-audit operators: principal profiles, action rarity, composite outliers, first-seen bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.operators.windows import gap_sessions


def interactive(events: DataFrame) -> DataFrame:
    return events.filter("lane = 'interactive'")


def lane_facts(events: DataFrame, floor: int = 20) -> DataFrame:
    """One row: interactive rows, and principals among them with fewer rows than the floor."""
    each = interactive(events).groupBy("principal").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("interactive_rows"), F.count_if(F.col("n") < floor).alias("below_floor"))


def principal_profile(events: DataFrame) -> DataFrame:
    """Per principal: volume, error rate, distinct values, read share, entropy of actions in bits."""
    named = events.filter("principal IS NOT NULL")
    base = named.groupBy("principal").agg(
        F.count("*").alias("events"), F.avg(F.col("error_code").isNotNull().cast("double")).alias("error_rate"), F.countDistinct("source_ip").alias("ips"),
        F.countDistinct("event_name").alias("names"), F.countDistinct("event_source").alias("services"), F.countDistinct("aws_region").alias("regions"),
        F.avg((F.col("read_write") == "read").cast("double")).alias("read_ratio"), F.countDistinct(F.floor(F.col("ts") / 3600) % 24).alias("hours"),
    )
    counts = named.groupBy("principal", "event_name").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("principal"))
    entropy = counts.withColumn("p", p).groupBy("principal").agg((-F.sum(F.col("p") * F.log2("p"))).alias("action_entropy"))
    return base.join(entropy, "principal")


def action_rarity(events: DataFrame) -> DataFrame:
    """log10(all events) - log10(events of the name), per event name."""
    counts = events.filter("event_name IS NOT NULL").groupBy("event_name").agg(F.count("*").alias("events"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("events").alias("total")))).select("event_name", "events", (F.log10("total") - F.log10("events")).alias("rarity"))  # one row on the right


def principal_composite(events: DataFrame, floor: int = 20, least: int = 5, bands: tuple[float, float] = (2.0, 1.0)) -> DataFrame:
    """Sum of population z-scores of error rate, log1p ips, log1p names and entropy; none under `least` principals."""
    scored = principal_profile(events).filter(F.col("events") >= floor).withColumns({"log_ips": F.log1p("ips"), "log_names": F.log1p("names")})
    parts = ("error_rate", "log_ips", "log_names", "action_entropy")
    facts = scored.agg(F.count("*").alias("_n"), *[F.avg(p).alias(f"_m_{p}") for p in parts], *[F.stddev_pop(p).alias(f"_s_{p}") for p in parts]).filter(F.col("_n") >= least)
    z = sum((F.when(F.col(f"_s_{p}") > 1e-12, (F.col(p) - F.col(f"_m_{p}")) / F.col(f"_s_{p}")).otherwise(0.0) for p in parts), F.lit(0.0))
    joined = scored.crossJoin(F.broadcast(facts)).withColumn("composite", z)  # one row on the right
    severity = F.when(F.col("composite") >= bands[0], "HIGH").when(F.col("composite") >= bands[1], "MEDIUM").otherwise("INFO")
    return joined.select("principal", "events", F.bround("composite", 4).alias("composite"), severity.alias("severity"))


def first_seen_actions(events: DataFrame) -> DataFrame:
    """First occurrence of each (principal, event name), less the principal's very first event."""
    of_action = Window.partitionBy("principal", "event_name").orderBy("ts", "row_id")
    of_principal = Window.partitionBy("principal").orderBy("ts", "row_id")
    rows = events.filter("principal IS NOT NULL AND event_name IS NOT NULL AND ts IS NOT NULL")
    marked = rows.withColumn("_first", F.row_number().over(of_action)).filter("_first = 1")
    # the first event overall is also a first occurrence, so the smallest of these is it
    return marked.withColumn("_start", F.row_number().over(of_principal)).filter("_start > 1").drop("_first", "_start")


def action_bursts(events: DataFrame, gap: float = 300.0, least: int = 3, edge: float = 3600.0) -> DataFrame:
    """Runs of first-seen actions: HIGH with errors in half of them, or with three services away from the window's edge."""
    bounds = events.agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    runs = gap_sessions(first_seen_actions(events), ["principal"], "ts", gap, ["row_id"], "burst")
    bursts = runs.groupBy("principal", "burst").agg(
        F.count("*").alias("actions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg(F.col("error_code").isNotNull().cast("double")).alias("error_ratio"),
        F.countDistinct("event_source").alias("services"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "row_id", "event_name"))), lambda x: x["event_name"]), ",").alias("names"),
    ).filter(F.col("actions") >= least)
    inside = F.col("first_ts") - F.col("_from") >= edge
    high = (F.col("error_ratio") >= 0.5) | ((F.col("services") >= 3) & inside)
    return bursts.crossJoin(F.broadcast(bounds)).withColumn("severity", F.when(high, "HIGH").otherwise("MEDIUM")).drop("_from", "_to", "burst")  # one row on the right
