"""Shared kernels: gap sessions, distinct values in a sliding range, modes and mixes, interval islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gap_sessions(df: DataFrame, keys: list[str], ts: str, gap: float, tie: list[str], name: str = "session") -> DataFrame:
    """Number the sessions of each key: a row that comes `gap` or more after its predecessor begins a new one."""
    order = Window.partitionBy(*keys).orderBy(ts, *tie)
    opens = F.coalesce((F.col(ts) - F.lag(ts).over(order) >= gap).cast("int"), F.lit(1))
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_opens")


def most_distinct_in_range(df: DataFrame, keys: list[str], value: str, ts: str, span: float, name: str) -> DataFrame:
    """Per key the largest number of distinct values within any closed time range of `span`, by a sweep line.

    A value is alive from each of its rows to its next one or to span later. Rows of equal (key, value, ts) count
    once, each (key, value) row becomes two steps, and a running sum gives the count: linear work, where collecting
    each range's values would be quadratic.
    """
    rows = df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*keys, value, ts).distinct()
    after = F.lead(ts).over(Window.partitionBy(*keys, value).orderBy(ts))
    steps = rows.withColumn("_next", after).withColumn("_kept", F.col("_next").isNotNull() & (F.col("_next") - F.col(ts) <= span))
    # an end that is a recurrence comes before that recurrence's start; an expiry after all starts of its instant
    begin = F.struct(F.col(ts).alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("step"))
    end = F.when(F.col("_kept"), F.struct(F.col("_next").alias("at"), F.lit(0).alias("turn"), F.lit(-1).alias("step"))).otherwise(
        F.struct((F.col(ts) + span).alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("step"))
    )
    events = steps.select(*keys, F.explode(F.array(begin, end)).alias("e")).select(*keys, "e.at", "e.turn", "e.step")
    events = events.groupBy(*keys, "at", "turn").agg(F.sum("step").alias("step"))
    running = F.sum("step").over(Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("_alive", running).groupBy(*keys).agg(F.max("_alive").alias(name))


def mode(df: DataFrame, keys: list[str], value: str, name: str, share: str | None = None) -> DataFrame:
    """The most frequent non-null value per key, the smallest on a tie, and its share of all the key's rows."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    whole = F.sum("_n").over(Window.partitionBy(*keys))
    first = Window.partitionBy(*keys).orderBy(F.col(value).isNull(), F.desc("_n"), value)
    top = counts.withColumn("_all", whole).withColumn("_r", F.row_number().over(first)).filter((F.col("_r") == 1) & F.col(value).isNotNull())
    return top.select(*keys, F.col(value).alias(name), *([(F.col("_n") / F.col("_all")).alias(share)] if share else []))


def mix(df: DataFrame, keys: list[str], value: str, name: str, weight: Column | None = None, top: int = 3) -> DataFrame:
    """Per key a text of its `top` values by weight (rows by default), as `value:weight`, ties by value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("_n"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_n"), value)
    head = counts.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= top)
    parts = F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", F.col(value).cast("string"), F.col("_n").cast("string")).alias("t"))))
    return head.groupBy(*keys).agg(parts.alias("_p")).select(*keys, F.array_join(F.transform("_p", lambda p: p["t"]), ",").alias(name))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Islands of overlapping or touching intervals per key: (keys, start, end, n)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    islands = opened.withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_i")


def order_statistic(df: DataFrame, keys: list[str], value: str, index: Column, name: str) -> DataFrame:
    """The value at a 0-based place of each key's sorted values, exactly, through a histogram."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    seen = counts.withColumn("_upto", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_n").over(Window.partitionBy(*keys)))
    return seen.filter(F.col("_upto") > index).groupBy(*keys).agg(F.min(value).alias(name))
