"""Text of findings and cards: control characters, labels, sizes, spans and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"


def strip_control(text: Column, keep_newlines: bool = False) -> Column:
    """Without C0, DEL and C1 control characters; newlines may stay."""
    return F.regexp_replace(text, r"[\x00-\x09\x0B-\x1F\x7F-\x9F]" if keep_newlines else r"[\x00-\x1F\x7F-\x9F]", "")


def clean_label(text: Column) -> Column:
    """A label without control characters and outer white space; `(unknown)` for nothing."""
    return F.coalesce(F.nullif(F.trim(strip_control(text)), F.lit("")), F.lit(UNKNOWN))


def human_bytes(n: Column) -> Column:
    """Bytes in the largest binary unit that leaves at least one: `512 B`, `1.5 KiB`."""
    out = F.concat(F.format_string("%.1f", n / F.lit(float(1 << 40))), F.lit(" TiB"))
    for power, unit in ((30, "GiB"), (20, "MiB"), (10, "KiB")):
        out = F.when(n < (1 << power + 10), F.concat(F.format_string("%.1f", n / F.lit(float(1 << power))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def compact_span(seconds: Column) -> Column:
    """A span in its two largest units: `45s`, `3m 20s`, `5h 0m`, `2d 4h`."""
    s = F.floor(seconds).cast("long")
    two = lambda big, a, small, b: F.concat(F.floor(s / big).cast("string"), F.lit(f"{a} "), F.floor(s % big / small).cast("string"), F.lit(b))
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, two(60, "m", 1, "s")).when(s < 86_400, two(3600, "h", 60, "m")).otherwise(two(86_400, "d", 3600, "h"))


def ratio_cell(ratio: Column) -> Column:
    """`2.5x`, and `>50x` beyond fifty."""
    return F.when(ratio > 50, F.lit(">50x")).otherwise(F.concat(F.format_string("%.1f", ratio), F.lit("x")))


def iso_utc(ts: Column) -> Column:
    """Epoch seconds as `YYYY-MM-DDTHH:MM:SSZ` in UTC; null for what is no finite time."""
    fine = ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < 253_402_300_800.0)
    return F.when(fine, F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.floor(ts)), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def time_evidence(first: Column, last: Column) -> Column:
    """struct(first_seen, last_seen, span_seconds); all null unless both times are finite."""
    both = iso_utc(first).isNotNull() & iso_utc(last).isNotNull()
    return F.struct(F.when(both, iso_utc(first)).alias("first_seen"), F.when(both, iso_utc(last)).alias("last_seen"), F.when(both, last - first).alias("span_seconds"))
