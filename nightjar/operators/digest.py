"""Descriptive cards: each statistic is a row (slot, statistic, entity, magnitude, ratio)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = "slot string, statistic string, entity string, magnitude double, ratio double"


def _row(df: DataFrame, slot: str, statistic: str, entity, magnitude, ratio) -> DataFrame:
    return df.select(F.lit(slot).alias("slot"), F.lit(statistic).alias("statistic"), entity.cast("string").alias("entity"), magnitude.cast("double").alias("magnitude"), F.bround(ratio.cast("double"), 4).alias("ratio"))


def _ranked(rows: DataFrame, entity: Column, weight: Column | None, top: int) -> DataFrame:
    counts = rows.select(entity.alias("e"), (weight if weight is not None else F.lit(1)).alias("w")).filter("e IS NOT NULL").groupBy("e").agg(F.sum("w").alias("m"))
    everything = counts.agg(F.sum("m").alias("total"), F.count("*").alias("entities"))
    # a global top-k: Spark merges k rows a partition
    return counts.orderBy(F.desc("m"), "e").limit(top).crossJoin(F.broadcast(everything))  # one row on the right


def cliff(rows: DataFrame, slot: str, entity: Column, weight: Column | None = None, ratio: float = 2.0, least: int = 5) -> DataFrame:
    """Top over second magnitude, if at least `ratio` and there are enough entities; else nothing."""
    two = _ranked(rows, entity, weight, 2).withColumn("r", F.row_number().over(Window.orderBy(F.desc("m"), "e")))  # two rows
    one = two.groupBy("entities").agg(F.max(F.when(F.col("r") == 1, F.col("e"))).alias("e"), F.max("m").alias("a"), F.min("m").alias("b"))
    return _row(one.filter((F.col("entities") >= least) & (F.col("a") >= ratio * F.col("b"))), slot, "cliff", F.col("e"), F.col("a"), F.col("a") / F.col("b"))


def share(rows: DataFrame, slot: str, entity: Column, weight: Column | None = None, least: float = 0.8) -> DataFrame:
    """The top entity's share of the whole, if at least `least`."""
    one = _ranked(rows, entity, weight, 1)
    return _row(one.filter(F.col("m") >= least * F.col("total")), slot, "share", F.col("e"), F.col("m"), F.col("m") / F.col("total"))


def rate(rows: DataFrame, slot: str, kind: Column, owner: Column, least: float = 0.01, floor: int = 5) -> DataFrame:
    """Share of rows of a kind, with its top contributor."""
    whole = rows.agg(F.count("*").alias("n"), F.count_if(kind).alias("k"))
    top = rows.filter(kind).groupBy(owner.alias("e")).agg(F.count("*").alias("m")).filter("e IS NOT NULL").orderBy(F.desc("m"), "e").limit(1)
    return _row(whole.filter((F.col("k") >= floor) & (F.col("k") >= least * F.col("n"))).join(F.broadcast(top), F.lit(True), "left"), slot, "rate", F.col("e"), F.col("k"), F.col("k") / F.col("n"))  # one row each


def dist(rows: DataFrame, slot: str, entity: Column, top: int = 3) -> DataFrame:
    """The top entities and their shares, never gated."""
    return _row(_ranked(rows, entity, None, top), slot, "dist", F.col("e"), F.col("m"), F.col("m") / F.col("total"))


def tail(rows: DataFrame, slot: str, owner: Column, value: Column, ratio: float = 3.0, least: int = 5) -> DataFrame:
    """Largest value over the exact median, with its owner."""
    vals = rows.select(owner.alias("e"), value.alias("v")).filter("v IS NOT NULL")
    one = vals.agg(F.count("*").alias("n"), F.max("v").alias("v"), F.percentile("v", 0.5).alias("m"), F.min_by("e", F.struct(-F.col("v"), "e")).alias("e"))
    return _row(one.filter((F.col("n") >= least) & (F.col("v") >= ratio * F.col("m"))), slot, "tail", F.col("e"), F.col("v"), F.col("v") / F.col("m"))


def select_insights(slots: DataFrame, top: int = 3) -> DataFrame:
    """Gated slots ranked by ratio; the first `top` are insights, the rest fields."""
    rank = F.row_number().over(Window.orderBy((F.col("statistic") == "dist"), F.desc("ratio"), "slot", "entity"))  # a handful of rows
    return slots.withColumn("role", F.when((rank <= top) & (F.col("statistic") != "dist"), "insight").otherwise("field"))


def conn_card(conn: DataFrame) -> DataFrame:
    ends = conn.withColumn("host", F.explode(F.array_distinct(F.array("src", "dst"))))
    spread = conn.groupBy("src").agg(F.countDistinct("dst").alias("n"))
    outbound = conn.filter("dst NOT LIKE '10.%'")
    parts = [
        cliff(ends, "conn_share", F.col("host")), cliff(conn, "densest", F.concat_ws(" ", "src", "dst", F.col("port").cast("string"))), tail(spread, "fan_out", F.col("src"), F.col("n"), 1.1),
        share(outbound, "outbound_bytes", F.col("src"), F.col("bytes"), 0.01), dist(conn, "states", F.col("conn_state")), rate(conn, "unanswered", F.col("conn_state").isin("S0", "REJ"), F.col("src")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return select_insights(out)


def weird_card(weird: DataFrame) -> DataFrame:
    """Anomalies: names and hosts that tower over the next, the mix of names, and of analyzers with none as a kind of its own."""
    analyzer = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("(none)"))
    parts = [cliff(weird, "name_volume", F.col("name"), ratio=1.0), cliff(weird, "host_volume", F.col("src"), ratio=1.0), dist(weird, "name_mix", F.col("name")), dist(weird, "analyzer_mix", analyzer)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    hostless = weird.agg(F.count_if(F.col("src").isNull()).alias("n"), F.count("*").alias("all")).filter("n > 0")
    return select_insights(out.unionByName(_row(hostless, "hostless", "dist", F.lit(None), F.col("n"), F.col("n") / F.col("all"))))


def time_histogram(rows: DataFrame, ts: str = "ts", most: int = 60, parseable: float = 0.8) -> DataFrame:
    """Rows per bin, zero-filled: hourly up to 48 hours, else daily; neighbours are summed until at most `most` bins are left.

    The right edge is closed. Nothing without a positive span or with too few usable times.
    """
    facts = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count("*").alias("n"), F.count(ts).alias("k"))
    width = F.when(F.col("hi") - F.col("lo") <= 48 * 3600, 3600.0).otherwise(86400.0)
    facts = facts.filter((F.col("k") >= parseable * F.col("n")) & (F.col("hi") > F.col("lo"))).withColumn("w", width)
    facts = facts.withColumn("bins", F.ceil((F.col("hi") - F.col("lo")) / F.col("w"))).withColumn("fold", F.ceil(F.col("bins") / most))
    facts = facts.withColumn("width", F.col("w") * F.col("fold")).withColumn("bins", F.ceil(F.col("bins") / F.col("fold")))
    counted = rows.filter(F.col(ts).isNotNull()).select(ts).crossJoin(F.broadcast(facts))  # one row on the right
    bins = counted.groupBy(F.least(F.floor((F.col(ts) - F.col("lo")) / F.col("width")), F.col("bins") - 1).alias("bin")).agg(F.count("*").alias("rows"))
    every = facts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"), "lo", "width")
    return every.join(bins, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("start"), F.coalesce("rows", F.lit(0)).alias("rows"))
