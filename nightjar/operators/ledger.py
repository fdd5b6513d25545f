"""Weekly ledger of names, and daily states that merge to any span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.frames import counted
from nightjar.operators.names import domain_exclusions

# Eligible weeks before a card speaks, weeks of burn-in, weeks in which a cohort returns soon and at last, share of weeks of a regular name.
LEAST_WEEKS, BURN_IN, SOON, HORIZON, REGULAR = 12, 2, 4, 8, 0.75


def usable_weeks(source: DataFrame, observed: DataFrame | None = None, least: int = 6) -> DataFrame:
    """(week, days, index, span): ISO weeks, by their Monday, with all seven source days and `least` days that are present and usable.

    observed: day, present, usable; a day without a row isn't usable. Without it every source day is. index counts weeks from 0, span is their number.
    """
    days = source.select("day").distinct()
    if observed is None:
        days = days.withColumn("good", F.lit(True))
    else:
        fit = observed.groupBy("day").agg(F.max(F.col("present") & F.col("usable")).alias("good"))
        days = days.join(fit, "day", "left")
    week = F.to_date(F.date_trunc("week", "day")).alias("week")
    whole = days.groupBy(week).agg(F.count("*").alias("_all"), F.count_if("good").alias("days")).filter((F.col("_all") == 7) & (F.col("days") >= least))
    return whole.select("week", "days", (F.row_number().over(Window.orderBy("week")) - 1).alias("index"), F.count("*").over(Window.partitionBy()).alias("span"))  # one row a week


def week_presence(rows: DataFrame, name: str = "query", at: str = "began", rules: DataFrame | None = None) -> DataFrame:
    """(domain, reason, week, rows): what was seen of each registrable domain a week, and rows of names without one by reason.

    It is a state that merges: the union of two, summed by its keys, is the state of both. Names are parsed once each.
    """
    seen = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name"), F.to_date(F.date_trunc("week", at)).alias("week")).agg(F.count("*").alias("rows"))
    facts = counted(domain_exclusions(seen.select("name").distinct(), rules))
    return merge_presence(seen.join(facts, "name"))


def merge_presence(states: DataFrame) -> DataFrame:
    return states.groupBy("domain", "reason", "week").agg(F.sum("rows").alias("rows"))


def domain_histories(presence: DataFrame, weeks: DataFrame) -> DataFrame:
    """One row per domain seen in a usable week: when it arrived, how it went on, and its class.

    A domain of the burn-in is early and has no class. Another is single-week, intermittent or regular once it has as many usable weeks behind its
    arrival as maturity asks for (4, 6 or 8 by span), else censored. Domains with eight weeks behind form the cohort.
    """
    held = presence.filter("domain IS NOT NULL").select("domain", "week").join(F.broadcast(weeks), "week")  # one row a week
    # indexes of weeks: at most one entry for each usable week of the archive
    each = held.groupBy("domain", "span").agg(F.array_sort(F.collect_set("index")).alias("seen"))
    each = each.withColumn("arrival", F.col("seen")[0]).withColumn("follow", F.col("span") - 1 - F.col("arrival"))
    maturity = F.when(F.col("span") <= 21, 4).when(F.col("span") <= 28, 6).otherwise(8)
    kind = (
        F.when(F.col("arrival") < BURN_IN, "early").when(F.col("follow") < maturity, "censored").when(F.size("seen") == 1, "single-week")
        .when(F.size("seen") / (F.col("follow") + 1) < REGULAR, "intermittent").otherwise("regular")
    )
    cohort = (F.col("arrival") >= BURN_IN) & (F.col("follow") >= HORIZON)
    soon = F.coalesce(F.get("seen", F.lit(1)) <= F.col("arrival") + SOON, F.lit(False))
    late = F.element_at("seen", -1) >= F.col("arrival") + HORIZON
    return each.select("domain", "span", "arrival", F.size("seen").alias("weeks"), kind.alias("presence"), cohort.alias("cohort"), (cohort & soon).alias("soon"), (cohort & late).alias("late"))


def arrival_weeks(histories: DataFrame, weeks: DataFrame) -> DataFrame:
    """(week, days, arrivals, rate) for each usable week behind the burn-in, none as 0; the rate is by usable day."""
    new = histories.filter(F.col("arrival") >= BURN_IN).groupBy(F.col("arrival").alias("index")).agg(F.count("*").alias("arrivals"))
    held = weeks.filter(F.col("index") >= BURN_IN).join(new, "index", "left").withColumn("arrivals", F.coalesce("arrivals", F.lit(0)))
    return held.select("week", "days", "arrivals", (F.col("arrivals") / F.col("days")).alias("rate"))


def domain_arrivals(presence: DataFrame, weeks: DataFrame) -> DataFrame:
    """One row: span and maturity, early domains, median and peak rate of arrivals, classes, cohort and excluded rows; none under 12 usable weeks.

    Exact at any number of domains.
    """
    told = domain_histories(presence, weeks)
    classes = {"early": "early", "single-week": "single_week", "intermittent": "intermittent", "regular": "regular", "censored": "censored"}
    facts = told.agg(*[F.count_if(F.col("presence") == kind).alias(name) for kind, name in classes.items()], *[F.count_if(name).alias(name) for name in ("cohort", "soon", "late")])
    peak = F.max(F.struct("rate", (-F.unix_date("week")).alias("d")))
    rates = arrival_weeks(told, weeks).agg(F.coalesce(F.percentile("rate", 0.5), F.lit(0.0)).alias("median_rate"), peak.alias("p"))
    rates = rates.select("median_rate", F.date_from_unix_date(-F.col("p.d")).alias("peak_week"), F.col("p.rate").alias("peak_rate"))
    span = weeks.agg(F.coalesce(F.max("span"), F.lit(0)).alias("span"))
    out = presence.agg(F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("rows"))), F.lit(0)).alias("excluded"))
    one = span.crossJoin(facts).crossJoin(rates).crossJoin(out)  # one row each
    speaks = F.col("span") >= LEAST_WEEKS
    maturity = F.when(speaks, F.when(F.col("span") <= 21, 4).when(F.col("span") <= 28, 6).otherwise(8))
    kept = [F.when(speaks, F.col(c)).alias(c) for c in [*facts.columns, *rates.columns]]
    return one.select("span", maturity.alias("maturity"), *kept, "excluded")


def day_states(rows: DataFrame, at: str = "began") -> DataFrame:
    """One row a UTC day: counts, sums, bounds and the longest connection with its earliest start. States of days merge to any span."""
    finite = F.col("duration").isNotNull() & ~F.isnan("duration")
    top = F.max(F.when(finite, F.struct(F.col("duration").cast("double").alias("duration"), (-F.unix_micros(at)).alias("t"))))
    web = F.col("port") == 443
    return rows.filter(F.col(at).isNotNull()).groupBy(F.to_date(at).alias("day")).agg(
        F.count("*").alias("rows"), F.count_if(finite).alias("measured"), F.count_if(finite & (F.col("duration") >= 86400)).alias("over_1d"),
        F.count_if(web & (F.col("proto") == "udp")).alias("udp"), F.count_if(web & (F.col("proto") == "tcp")).alias("tcp"),
        F.min(F.unix_micros(at)).alias("first"), F.max(F.unix_micros(at)).alias("last"), top.alias("top"),
    )


def day_keys(rows: DataFrame, key: str, at: str = "began") -> DataFrame:
    """(day, key, rows): the set of a day's keys as a state; sets merge by union."""
    return rows.filter(F.col(at).isNotNull() & F.col(key).isNotNull()).groupBy(F.to_date(at).alias("day"), key).agg(F.count("*").alias("rows"))


def replace_days(states: DataFrame, path: str) -> None:
    """Write states to a table partitioned by day; a day that is sent again replaces what was held of it, other days stay."""
    states.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merge_days(states: DataFrame, *span) -> DataFrame:
    """States of days merged by `span` (any expressions over day; none: to one row): the same as the reducers over the rows themselves."""
    whole = states.groupBy(*span).agg(
        F.count("*").alias("days"), *[F.sum(c).alias(c) for c in ("rows", "measured", "over_1d", "udp", "tcp")], F.min("first").alias("first"), F.max("last").alias("last"), F.max("top").alias("top"),
    )
    web = F.col("udp") + F.col("tcp")
    facts = whole.withColumns({"udp_share": F.when(web > 0, F.col("udp") / web), "longest": F.col("top.duration"), "started": F.timestamp_micros(-F.col("top.t")), "first": F.timestamp_micros("first"), "last": F.timestamp_micros("last")})
    return facts.drop("top")


def merge_keys(states: DataFrame, key: str, *span) -> DataFrame:
    """Distinct keys of days merged by `span`, with their rows."""
    held = states.select(*span, F.col(key).alias("_k"), F.col("rows").alias("_n"))
    names = held.columns[:-2]
    return held.groupBy(*names, "_k").agg(F.sum("_n").alias("_n")).groupBy(*names).agg(F.count("*").alias("keys"), F.sum("_n").alias("key_rows"))
