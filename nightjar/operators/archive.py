"""Archive cards over long spans: days, weeks, shares, medians and arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day_shards(rows: DataFrame, at: str = "began") -> DataFrame:
    """Rows per UTC day, days without rows kept."""
    days = rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("rows"))
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).filter("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return span.join(days, "day", "left").select("day", F.coalesce("rows", F.lit(0)).alias("rows"))


def weeks(rows: DataFrame, at: str = "began", days: int = 7) -> DataFrame:
    """ISO weeks (by their Monday) with rows on `days` days or more."""
    daily = rows.select(F.to_date(F.date_trunc("week", at)).alias("week"), F.to_date(at).alias("day")).distinct()
    return daily.groupBy("week").agg(F.count("*").alias("days")).filter(F.col("days") >= days)


def week_over_week(rows: DataFrame, floor: int = 100, days: int = 7) -> DataFrame:
    """UDP share of port 443 per eligible week, its change, and which change is the largest (earliest on a tie)."""
    good = weeks(rows, days=days).select("week")
    shares = rows.filter("port = 443").withColumn("week", F.to_date(F.date_trunc("week", "began"))).join(good, "week", "left_semi")
    shares = shares.groupBy("week").agg(F.count("*").alias("rows"), F.avg((F.col("proto") == "udp").cast("double")).alias("share")).filter(F.col("rows") >= floor)
    moved = shares.withColumn("move", F.col("share") - F.lag("share").over(Window.orderBy("week")))  # one row a week
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs("move")), "week"))
    return moved.withColumn("largest", (rank == 1) & F.col("move").isNotNull()).select("week", "rows", F.bround("share", 6).alias("share"), F.bround("move", 6).alias("move"), "largest")


def longest_connection(rows: DataFrame) -> DataFrame:
    """One row: the longest duration, its earliest start, rows with a duration, rows of a day and more."""
    finite = F.col("duration").isNotNull() & ~F.isnan("duration")
    top = F.max(F.when(finite, F.struct("duration", (-F.unix_micros("began")).alias("t"))))
    facts = rows.agg(top.alias("m"), F.count("*").alias("rows"), F.count_if(finite).alias("measured"), *[F.count_if(finite & (F.col("duration") >= d * 86400)).alias(f"over_{d}d") for d in (1, 7, 14)])
    return facts.select(F.col("m.duration").alias("longest"), F.timestamp_micros(-F.col("m.t")).alias("started"), "rows", "measured", "over_1d", "over_7d", "over_14d")


def weekday_shape(rows: DataFrame, least_days: int = 8) -> DataFrame:
    """Median daily rows per weekday (1 is Sunday) with enough days."""
    daily = rows.groupBy(F.to_date("began").alias("day")).agg(F.count("*").alias("n"))
    return daily.groupBy(F.dayofweek("day").alias("weekday")).agg(F.count("*").alias("days"), F.percentile("n", 0.5).alias("median_rows")).filter(F.col("days") >= least_days)


def busiest_minute(rows: DataFrame) -> DataFrame:
    """One row: the busiest minute, the runner-up's rows, whether they tie, and the zero-filled median of all minutes."""
    minutes = rows.groupBy(F.date_trunc("minute", "began").alias("minute")).agg(F.count("*").alias("n"))
    ranked = minutes.orderBy(F.desc("n"), "minute").limit(2)
    two = ranked.agg(F.max(F.struct("n", (-F.unix_micros("minute")).alias("t"))).alias("a"), F.min("n").alias("low"), F.count("*").alias("k"))
    histogram = minutes.groupBy("n").agg(F.count("*").alias("c"))
    facts = minutes.agg(((F.unix_seconds(F.max("minute")) - F.unix_seconds(F.min("minute"))) / 60 + 1).cast("long").alias("span"), F.count("*").alias("held"))
    zeros = facts.select(F.lit(0).cast("long").alias("n"), (F.col("span") - F.col("held")).alias("c"))
    whole = histogram.unionByName(zeros).filter("c > 0")
    median = whole.agg(F.percentile("n", 0.5, F.col("c")).alias("median"))
    return two.crossJoin(median).select(F.timestamp_micros(-F.col("a.t")).alias("minute"), F.col("a.n").alias("rows"), F.when(F.col("k") > 1, F.col("low")).alias("runner_up"), ((F.col("k") > 1) & (F.col("low") == F.col("a.n"))).alias("tie"), "median")  # one row each


def sustained_shift(rows: DataFrame, days: int = 7, around: int = 4) -> DataFrame:
    """At each boundary between eligible weeks: medians of the `around` weeks before and after, abs(log2) of their ratio."""
    weekly = rows.withColumn("week", F.to_date(F.date_trunc("week", "began"))).join(weeks(rows, days=days).select("week"), "week", "left_semi").groupBy("week").agg(F.count("*").alias("n"))
    order = Window.orderBy("week")  # one row a week
    before = F.percentile("n", 0.5).over(order.rowsBetween(-around, -1))
    after = F.percentile("n", 0.5).over(order.rowsBetween(0, around - 1))
    have = F.count("*").over(order.rowsBetween(-around, -1)) + F.count("*").over(order.rowsBetween(0, around - 1))
    framed = weekly.select("week", before.alias("before"), after.alias("after"), have.alias("have")).filter(F.col("have") == 2 * around)
    size = F.abs(F.log2(F.col("after") / F.col("before")))
    return framed.select("week", "before", "after", F.bround(size, 6).alias("shift"), (F.row_number().over(Window.orderBy(F.desc(F.bround(size, 6)), "week")) == 1).alias("largest"))


def seen_cumulative(rows: DataFrame, key: str, bin_of) -> DataFrame:
    """Distinct keys first seen in each bin, and their running total."""
    first = rows.groupBy(key).agg(F.min(bin_of).alias("bin")).groupBy("bin").agg(F.count("*").alias("new"))
    return first.withColumn("seen", F.sum("new").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))  # one row a bin


def external_addresses(conn: DataFrame, home_net=None) -> DataFrame:
    """One row: distinct external destinations, or none with a flag if an address can't be classified."""
    from nightjar.functions.net import HOME_NET, classify_addresses

    faced = classify_addresses(conn.select("dst").distinct(), "dst", home_net or HOME_NET)
    counts = faced.agg(F.count_if("dst_facts.external").alias("n"), F.max(~F.coalesce("dst_facts.parsed", F.lit(False))).alias("unclassifiable"))
    return counts.select(F.when(~F.col("unclassifiable"), F.col("n")).alias("addresses"), "unclassifiable")


def largest_outbound(conn: DataFrame, home_net=None) -> DataFrame:
    """One row: the most originator bytes of a connection from home to outside with both byte counts, its earliest time and ends; none if an address can't be classified."""
    from nightjar.functions.net import HOME_NET, classify_addresses

    faced = classify_addresses(conn, ["src", "dst"], home_net or HOME_NET)
    unknown = F.max(~(F.col("src_facts.parsed") & F.col("dst_facts.parsed")))
    out = F.col("src_facts.local") & F.col("dst_facts.external") & (F.col("bytes") >= 0) & (F.col("resp_bytes") >= 0)
    best = F.max(F.when(out, F.struct("bytes", (-F.col("ts")).alias("t"), "src", "dst")))
    one = faced.agg(best.alias("m"), unknown.alias("unclassifiable"))
    known = lambda c: F.when(~F.col("unclassifiable"), c)
    return one.select(known(F.col("m.bytes")).alias("bytes"), known(-F.col("m.t")).alias("ts"), known(F.col("m.src")).alias("src"), known(F.col("m.dst")).alias("dst"), "unclassifiable")


def capture_loss(intervals: DataFrame) -> DataFrame:
    """Per peer: intervals, seconds, gaps, acks and the share of gaps in per cent; never over several peers."""
    sums = intervals.groupBy("peer").agg(F.count("*").alias("intervals"), F.sum("seconds").alias("seconds"), F.sum("gaps").alias("gaps"), F.sum("acks").alias("acks"))
    both = F.col("gaps") + F.col("acks")
    return sums.withColumn("loss", F.when(both > 0, F.bround(100 * F.col("gaps") / both, 6)))
