"""Blocked names that are new to an address: normal forms, arrivals, their routes, and how they fold with bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.frames import checkpointed, counted
from nightjar.functions.net import distinct_addresses, with_dimension, with_domain
from nightjar.operators.names import BLOCKED

DAY = 86_400.0


def normalised(rows: DataFrame, name: str = "query", address: str = "src") -> DataFrame:
    """rows with name, address and reason: why a row can't be used (null if it can).

    Names are lowered, without trailing dots, of two labels at least, of at most 253 bytes and without control
    characters. Addresses are IPv4, also out of IPv6 form, or IPv6 in 32 hex digits.
    """
    dimension = counted(distinct_addresses(rows, [address]))
    placed = with_dimension(rows, dimension, address, ["number", "wide"], "_a")
    dotted = F.concat_ws(".", *[F.shiftright("_a.number", 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])
    bare = F.regexp_replace(F.lower(name), r"\.+$", "")
    reason = (
        F.when(F.col("ts").isNull() | F.isnan("ts"), "invalid_timestamp").when(F.col(name).isNull(), "invalid_name").when(F.col(name).rlike(r"[\x00-\x1F\x7F]"), "control_in_name").when(~bare.contains("."), "invalid_name")
        .when(F.octet_length(bare) > 253, "name_too_long").when(F.col("_a.number").isNull() & F.col("_a.wide").isNull(), "invalid_address")
    )
    return placed.withColumns({"name": bare, "address": F.when(F.col("_a.number").isNotNull(), dotted).otherwise(F.col("_a.wide")), "reason": reason}).drop("_a")


def cells(pihole: DataFrame, report_end: float) -> tuple[DataFrame, DataFrame]:
    """(address, name, period, rows, first_ts) of usable queries up to the report's end, and (name, day, blocked) of what became of names.

    Periods are days back from the end: period 0 is (end - 1 day, end].
    """
    asked = normalised(pihole.filter("event_type = 'query'")).filter(F.col("reason").isNull() & (F.col("ts") <= report_end))
    period = F.floor((F.lit(report_end) - F.col("ts")) / DAY).cast("long")
    # both tables are read by several branches from here on, and are far smaller than the lane
    pairs = checkpointed(asked.groupBy("address", "name", period.alias("period")).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
    became = pihole.filter(F.col("event_type").isin("forwarded", "cached", *BLOCKED) & F.col("ts").isNotNull() & (F.col("ts") <= report_end))
    days = became.select(F.regexp_replace(F.lower("query"), r"\.+$", "").alias("name"), F.floor(F.col("ts") / DAY).cast("long").alias("day"), F.col("event_type").isin(*BLOCKED).alias("blocked")).distinct()
    return pairs, checkpointed(days)


def name_routes(pairs: DataFrame, days: DataFrame, report: int) -> DataFrame:
    """(address, name) of the last `report` periods whose name was blocked, with family, period of its latest use and route.

    A name was handled before (forwarded or cached on a day before its first block), on the same day, asked for by the address before
    that period, or qualifies.
    """
    facts = days.groupBy("name").agg(F.min(F.when(F.col("blocked"), F.col("day"))).alias("block_day"), F.min(F.when(~F.col("blocked"), F.col("day"))).alias("handled"), F.array_distinct(F.collect_list(F.when(~F.col("blocked"), F.col("day")))).alias("_days"))
    facts = facts.filter("block_day IS NOT NULL").withColumn("same_day", F.array_contains("_days", F.col("block_day"))).drop("_days")  # a day a member
    uses = pairs.groupBy("address", "name").agg(F.min("first_ts").alias("asked"), F.min_by(F.struct("period", "first_ts"), "period").alias("latest"), F.sum("rows").alias("rows"))
    recent = uses.filter(F.col("latest.period") < report).join(facts, "name")
    route = F.when(F.col("handled") < F.col("block_day"), "prior_handling").when(F.col("same_day"), "same_day_ambiguous").when(F.col("asked") < F.col("latest.first_ts"), "prior_address_query").otherwise("qualifying")
    routed = checkpointed(recent.select("address", "name", F.col("latest.period").alias("period"), F.col("latest.first_ts").alias("first_ts"), "rows", route.alias("route")))
    return with_domain(routed, "name", "family")


def pair_routes(named: DataFrame, pairs: DataFrame, report: int, history: int = 21, active: int = 5, together: int = 3) -> DataFrame:
    """Every (address, family) with exactly one route, and its qualifying names, latest period, active periods and rows.

    In order: no qualifying name, too few periods with any query before, no activity of the address before, too few active periods,
    withheld because at least `together` addresses got the family in one period, qualifying.
    """
    good = F.col("route") == "qualifying"
    pair = named.groupBy("address", "family").agg(F.count_if(good).alias("names"), F.max(F.when(good, F.col("period"))).alias("period"), F.sum(F.when(good, F.col("rows"))).alias("rows"), F.min(F.when(good, F.col("first_ts"))).alias("first_ts"))
    used = named.filter(good).select("address", "name", "family").join(pairs.filter(F.col("period") < report).select("address", "name", F.col("period").alias("p")), ["address", "name"]).groupBy("address", "family").agg(F.countDistinct("p").alias("active"))
    eligible = pairs.select("period").distinct()  # at most a row a day
    order = Window.orderBy(F.desc("period"))
    upto = eligible.select("period", (F.row_number().over(order) - 1).alias("before"))
    first = pairs.groupBy("address").agg(F.max("period").alias("oldest"))
    joined = pair.join(used, ["address", "family"], "left").join(F.broadcast(upto), "period", "left").join(first, "address", "left")
    early = (
        F.when(F.col("names") == 0, "no_qualifying_name").when(F.coalesce("before", F.lit(0)) < history, "insufficient_history").when(~F.coalesce(F.col("oldest") > F.col("period"), F.lit(False)), "no_prior_address_activity")
        .when(F.coalesce("active", F.lit(0)) < active, "insufficient_active_periods")
    )
    routed = joined.withColumn("_early", early)
    groups = routed.filter("_early IS NULL").groupBy("family", "period").agg(F.count("*").alias("_together"))
    sync = routed.join(groups, ["family", "period"], "left")
    final = F.coalesce("_early", F.when(F.col("_together") >= together, "sync_withheld").otherwise("qualifying"))
    return sync.select("address", "family", final.alias("route"), "names", "period", F.coalesce("active", F.lit(0)).cast("long").alias("active"), "rows", "first_ts")


def fold_arrivals(arrivals: DataFrame, least: int = 4, members: int = 100) -> DataFrame:
    """Arrivals of one address: `least` or more are one row, else a row each; at most `members` families are listed, all are counted."""
    ranked = arrivals.withColumn("_r", F.row_number().over(Window.partitionBy("address").orderBy("family")))
    listed = F.array_sort(F.collect_list(F.when(F.col("_r") <= members, F.col("family"))))
    sized = ranked.groupBy("address").agg(F.count("*").alias("arrivals"), listed.alias("_m"), F.sum("names").alias("names"), F.sum("rows").alias("rows"), F.min("first_ts").alias("first_ts"))
    folded = sized.filter(F.col("arrivals") >= least).select("address", F.lit("fold").alias("kind"), "arrivals", F.array_join("_m", ",").alias("members"), "names", "rows", "first_ts")
    alone = arrivals.join(sized.filter(F.col("arrivals") < least).select("address"), "address", "left_semi")
    single = alone.select("address", F.lit("single").alias("kind"), F.lit(1).cast("long").alias("arrivals"), F.col("family").alias("members"), "names", "rows", "first_ts")
    return folded.unionByName(single)


def resolve_shapes(worklist: DataFrame, bursts: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Every (address, family) of the worklist as burst_only, arrival_only, overlap (one burst that carries the arrival's facts) or neither."""
    b = bursts.select("address", "family", "peak_period", "peak")
    a = arrivals.select("address", "family", F.col("period").alias("arrival_period"), F.col("names").alias("arrival_names"))
    both = worklist.select("address", "family").distinct().join(b, ["address", "family"], "left").join(a, ["address", "family"], "left")
    burst, arrival = F.col("peak").isNotNull(), F.col("arrival_period").isNotNull()
    return both.withColumn("shape", F.when(burst & arrival, "overlap").when(burst, "burst_only").when(arrival, "arrival_only").otherwise("neither"))


def calibration_grid(named: DataFrame, pairs: DataFrame, report: int, histories: tuple[int, ...] = (14, 21, 28), actives: tuple[int, ...] = (3, 5, 7, 10)) -> DataFrame:
    """Route counts and a digest of the qualifying pairs for every cell of the parameter grid."""
    out = None
    for h in histories:
        for k in actives:
            routed = pair_routes(named, pairs, report, h, k)
            ids = F.when(F.col("route") == "qualifying", F.concat_ws(" ", "address", "family"))
            # an order-free digest, so that no list of pairs is gathered
            cell = routed.agg(F.count("*").alias("pairs"), F.count(ids).alias("qualifying"), F.count_if(F.col("route") == "sync_withheld").alias("withheld"), F.coalesce(F.bit_xor(F.xxhash64(ids)), F.lit(0)).alias("digest"))
            row = cell.select(F.lit(h).alias("history"), F.lit(k).alias("active"), "pairs", "qualifying", "withheld", "digest")
            out = row if out is None else out.unionByName(row)
    return out
