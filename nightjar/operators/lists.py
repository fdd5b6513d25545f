"""Allow-list suppression by pattern, feed arbitration, and windows."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pattern_regex(patterns: Iterable[str]) -> tuple[str, list[str]]:
    """One regular expression for all patterns, and those that are malformed.

    A glob (`*`, `?`) is anchored at both ends; `re:` patterns match anywhere.
    """
    parts, bad = [], []
    for p in patterns:
        if p.startswith("re:"):
            try:
                re.compile(p[3:])
            except re.error:
                bad.append(p)
                continue
            parts.append(f"(?:{p[3:]})")
        else:
            glob = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p.lower())
            parts.append(f"(?:^{glob}$)")
    return "|".join(parts), bad


def suppressed_names(df: DataFrame, column: str, patterns: Iterable[str], apex: bool = True) -> DataFrame:
    """Distinct lower-cased values that a pattern matches, bare or (for domains) as `x.` of the value."""
    regex, _ = pattern_regex(patterns)
    names = df.select(F.lower(column).alias("_name")).filter("_name IS NOT NULL").distinct()
    if not regex:
        return names.limit(0)
    hit = F.col("_name").rlike(regex)
    return names.filter(hit | F.concat(F.lit("x."), "_name").rlike(regex) if apex else hit)


def suppress(df: DataFrame, column: str, patterns: Iterable[str], apex: bool = True) -> DataFrame:
    """Rows whose value no pattern matches; the patterns run over distinct values."""
    return df.join(suppressed_names(df, column, patterns, apex), F.lower(column) == F.col("_name"), "left_anti")


def arbitrate(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows of hosts that the local feed doesn't cover; hosts compare without case, `unknown` is never covered."""
    covered = local.select(F.lower("host").alias("_host")).filter("_host <> 'unknown'").distinct()
    return remote.join(covered, F.lower("host") == F.col("_host"), "left_anti")


def trailing_window(df: DataFrame, span: float, keep_null: bool = False) -> DataFrame:
    """Rows within `span` seconds of the family's own latest time."""
    last = df.agg(F.max("ts").alias("_last"))
    inside = F.col("ts") >= F.col("_last") - span
    return df.crossJoin(F.broadcast(last)).filter(inside | F.col("ts").isNull() if keep_null else inside).drop("_last")  # one row on the right


def dual_window(df: DataFrame, since: float, until: float, context: float) -> DataFrame:
    """in_report for the closed interval, in_context for the strictly earlier `context` seconds before it."""
    ts = F.col("ts")
    return df.withColumn("in_report", F.coalesce(ts.between(since, until), F.lit(False))).withColumn("in_context", F.coalesce((ts >= since - context) & (ts < since), F.lit(False)))


def lane_summary(lanes: dict[str, DataFrame]) -> DataFrame:
    """Per lane: rows, rows with a time, bounds."""
    out = None
    for name, df in lanes.items():
        one = df.agg(F.count("*").alias("rows"), F.count("ts").alias("timed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(F.lit(name).alias("lane"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def text_profile(lines: DataFrame, file: str = "file", value: str = "value", top: int = 3) -> DataFrame:
    """Per file: lines, length statistics, printable share, JSON share, most frequent tokens."""
    from nightjar.operators.windows import mix

    n = F.length(value)
    facts = lines.groupBy(file).agg(
        F.count("*").alias("lines"), F.bround(F.avg(n), 4).alias("mean_length"), F.percentile(n, 0.5).alias("median_length"), F.percentile(n, 0.95).alias("p95_length"), F.bround(F.stddev_pop(n), 4).alias("stddev_length"),
        F.bround(F.sum(F.length(F.regexp_replace(value, r"[^\x20-\x7E]", ""))) / F.greatest(F.sum(n), F.lit(1)), 4).alias("printable"), F.bround(F.avg(F.col(value).rlike(r"^\s*\{.*\}\s*$").cast("double")), 4).alias("json_share"),
    )
    tokens = lines.select(file, F.explode(F.split(value, " ")).alias("token")).filter("token <> ''")
    return facts.join(mix(tokens, [file], "token", "top_tokens", top=top), file, "left")
