"""DNS and resolver-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.net import label_score, name_domains, with_domain

DAY = 86_400.0
BLOCKED = ("gravity_blocked", "regex_blocked", "exact_blocked")


def name_facts(df: DataFrame, column: str = "query", rules: DataFrame | None = None) -> DataFrame:
    """One row per distinct name: registrable domain, shape, and the largest label score left of it.

    Names are distinct before they are scored, and their labels are rows: a score is worked out once a label, in a plain projection.
    """
    names = df.select(F.lower(column).alias("name")).filter("name IS NOT NULL AND name <> ''").distinct()
    facts = name_domains(names, rules).filter("domain IS NOT NULL")
    own = F.size(F.split("domain", r"\."))
    left = F.slice("labels", 1, F.greatest(F.size("labels") - own, F.lit(0)))
    scored = F.when(F.size(left) == 0, F.slice("labels", 1, 1)).otherwise(left)
    each = facts.select("name", "domain", F.size("labels").alias("parts"), F.explode(scored).alias("label")).withColumn("score", label_score(F.col("label")))
    best = each.groupBy("name", "domain", "parts").agg(F.max("score").alias("score"))
    return best.select("name", "domain", F.length("name").alias("length"), "parts", F.length("domain").alias("domain_length"), "score")


def query_shapes(dns: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per distinct query: length and labels without empty ones, its last two labels' lengths, the last label, its registrable domain's length."""
    named = name_domains(dns.select(F.col("query").alias("name")).filter("name IS NOT NULL").distinct(), rules)
    last = lambda k: F.coalesce(F.get("labels", F.size("labels") - k), F.lit(""))
    return named.select(
        F.col("name").alias("query"), F.length(F.array_join("labels", ".")).alias("length"), F.size("labels").alias("parts"), F.length("domain").alias("domain_length"),
        F.length(last(1)).alias("suffix_len"), F.length(last(2)).alias("second_len"), last(1).alias("suffix"),
    )


def domain_exclusions(names: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Distinct names (column name) with their registrable domain, or the reason why they have none."""
    found = name_domains(names, rules)
    bare = F.regexp_replace(F.lower(F.trim("name")), r"\.+$", "")
    reason = (
        F.when((bare == "") | bare.rlike(r"^\.|\.\.") , "malformed").when(bare.rlike(r"(^|\.)arpa$"), "ptr-arpa").when(bare.rlike(r"(^|\.)local$"), "mdns-local").when(bare.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") | bare.contains(":"), "ip-literal")
        .when(~bare.contains("."), "single-label").when(F.col("suffix_labels").isNull(), "malformed").when(F.col("suffix_labels") >= F.size("labels"), "public-suffix-only")
    )
    return found.select("name", F.when(reason.isNull(), F.col("domain")).alias("domain"), reason.alias("reason"))


def candidates(dns: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Per query name: rows, distinct sources, NXDOMAIN rows, rcode map, bounds, and whether a resolver blocked it."""
    named = dns.filter("query IS NOT NULL").withColumn("name", F.lower("query"))
    base = named.groupBy("name").agg(F.count("*").alias("rows"), F.countDistinct("src").alias("sources"), F.count_if(F.col("rcode") == 3).alias("nxdomain"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    codes = named.filter("rcode IS NOT NULL").groupBy("name", "rcode").agg(F.count("*").alias("n"))
    maps = codes.groupBy("name").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("rcode").cast("string"), "n"))))).alias("rcodes"))
    out = base.join(maps, "name", "left")
    if blocked is not None:
        out = out.join(blocked.select(F.lower("query").alias("name")).distinct().withColumn("blocked", F.lit(True)), "name", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return out


def group_findings(dns: DataFrame, least_score: float = 1.8, names: int = 2) -> DataFrame:
    """High-scoring names by registrable domain: a group of `names` or more, else singletons, with NXDOMAIN majority."""
    high = candidates(dns).join(name_facts(dns).filter(F.col("score") >= least_score), "name")
    groups = high.groupBy("domain").agg(F.count("*").alias("names"), F.sum("rows").alias("rows"), F.sum("nxdomain").alias("nxdomain"), F.max("score").alias("top_score"), F.max("sources").alias("most_sources"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    major = (F.col("nxdomain") / F.col("rows") >= 0.5) & (F.col("nxdomain") >= 2)
    return groups.select("domain", F.when(F.col("names") >= names, "group").otherwise("single").alias("kind"), "names", "rows", "nxdomain", F.bround("top_score", 4).alias("top_score"), "most_sources", "first_ts", "last_ts", F.when(major, "HIGH").otherwise("MEDIUM").alias("severity"))


def below_gate(dns: DataFrame, gate: float = 1.8, names: int = 5, nx_share: float = 0.9) -> DataFrame:
    """Families of many names that all stay under the gate and mostly don't exist, unless the domain surfaced already."""
    scored = candidates(dns).join(name_facts(dns), "name")
    families = scored.groupBy("domain").agg(F.count("*").alias("names"), F.max("score").alias("top"), F.sum("rows").alias("rows"), F.sum("nxdomain").alias("nxdomain"))
    low = families.filter((F.col("names") >= names) & (F.col("top") < gate) & (F.col("nxdomain") / F.col("rows") >= nx_share))
    return low.join(group_findings(dns, gate).select("domain"), "domain", "left_anti").select("domain", "names", "rows", "nxdomain")


def domain_dispositions(pihole: DataFrame) -> DataFrame:
    """Per queried name: counts of each disposition, clients, query types as JSON, ratios, bounds."""
    queried = pihole.filter("event_type = 'query' AND query IS NOT NULL").select("query").distinct()
    rows = pihole.join(queried, "query", "left_semi")
    kind = F.col("event_type")
    base = rows.groupBy("query").agg(
        F.count_if(kind == "query").alias("queries"), F.count_if(kind == "forwarded").alias("forwarded"), F.count_if(kind == "cached").alias("cached"), F.count_if(kind.isin(*BLOCKED)).alias("blocked"),
        F.count("*").alias("total"), F.countDistinct("src").alias("clients"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    types = rows.filter("qtype IS NOT NULL").groupBy("query", "qtype").agg(F.count("*").alias("n"))
    maps = types.groupBy("query").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("qtype", "n"))))).alias("qtypes"))
    answered = F.col("forwarded") + F.col("cached") + F.col("blocked")
    return base.join(maps, "query", "left").withColumn("block_ratio", F.when(answered > 0, F.col("blocked") / answered).otherwise(0.0))


def enrich_with_blocks(dns: DataFrame, dispositions: DataFrame) -> DataFrame:
    """dns rows with their registrable domain's block ratio; names that no resolver saw have 0 and false."""
    by_domain = with_domain(dispositions, "query").groupBy("domain").agg(F.sum("blocked").alias("_b"), F.sum(F.col("forwarded") + F.col("cached") + F.col("blocked")).alias("_a"))
    ratio = by_domain.select("domain", F.when(F.col("_a") > 0, F.col("_b") / F.col("_a")).otherwise(0.0).alias("block_ratio"), (F.col("_b") > 0).alias("was_blocked"))
    joined = with_domain(dns, "query").join(ratio, "domain", "left")
    return joined.withColumns({"block_ratio": F.coalesce("block_ratio", F.lit(0.0)), "was_blocked": F.coalesce("was_blocked", F.lit(False))})


def anchor_facts(pihole: DataFrame) -> DataFrame:
    """Per event type, and in all as `*`: rows, usable rows, bounds."""
    usable = F.col("ts").isNotNull() & ~F.isnan("ts")
    agg = [F.count("*").alias("rows"), F.count_if(usable).alias("usable"), F.min(F.when(usable, F.col("ts"))).alias("first_ts"), F.max(F.when(usable, F.col("ts"))).alias("last_ts")]
    return pihole.rollup("event_type").agg(*agg, F.grouping("event_type").alias("_g")).withColumn("event_type", F.when(F.col("_g") == 1, "*").otherwise(F.coalesce("event_type", F.lit("unknown")))).drop("_g")


def block_cells(pihole: DataFrame, report_end: float) -> DataFrame:
    """(address, name, period) of blocked names that an address asked for: periods are (start, end], counted back from the end."""
    blocked = pihole.filter(F.col("event_type").isin(*BLOCKED)).select(F.lower("query").alias("name"), F.floor(F.col("ts") / DAY).cast("long").alias("day")).distinct()
    asked = pihole.filter("event_type = 'query' AND src IS NOT NULL AND ts IS NOT NULL").withColumn("name", F.lower("query")).withColumn("day", F.floor(F.col("ts") / DAY).cast("long"))
    hit = asked.join(blocked, ["name", "day"], "left_semi").filter(F.col("ts") <= report_end)
    return hit.groupBy(F.col("src").alias("address"), "name", F.floor((F.lit(report_end) - F.col("ts")) / DAY).cast("long").alias("period")).agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def burst_route(cells: DataFrame, active: int = 4, peak: int = 400, times: int = 12) -> DataFrame:
    """(address, family) pairs whose peak period stands out over the others' median; the oldest of equal peaks counts.

    The baseline is held as twice the median, in whole numbers: the sum of the two middle counts.
    """
    daily = with_domain(cells, "name", "family").groupBy("address", "family", "period").agg(F.sum("rows").alias("rows"))
    top = Window.partitionBy("address", "family").orderBy(F.desc("rows"), F.desc("period"))
    rest = Window.partitionBy("address", "family").orderBy("rows", "period")
    ranked = daily.withColumn("_p", F.row_number().over(top))
    head = ranked.filter("_p = 1").select("address", "family", F.col("period").alias("peak_period"), F.col("rows").alias("peak"))
    others = ranked.filter("_p > 1").withColumn("_i", F.row_number().over(rest)).withColumn("_n", F.count("*").over(Window.partitionBy("address", "family")))
    middle = others.filter("_i IN (floor((_n + 1) / 2), floor(_n / 2) + 1)").groupBy("address", "family").agg((F.sum("rows") * F.when(F.count("*") == 1, 2).otherwise(1)).alias("twice_median"), (F.max("_n") + 1).alias("active_periods"))
    both = head.join(middle, ["address", "family"])
    return both.filter((F.col("active_periods") >= active) & (F.col("peak") >= peak) & (2 * F.col("peak") >= times * F.col("twice_median")))


def recurring(cells: DataFrame, least: int = 4) -> DataFrame:
    """One row: pairs, families and addresses of (address, family) pairs active in `least` periods or more."""
    pairs = with_domain(cells, "name", "family").groupBy("address", "family").agg(F.countDistinct("period").alias("periods")).filter(F.col("periods") >= least)
    return pairs.agg(F.count("*").alias("pairs"), F.countDistinct("family").alias("families"), F.countDistinct("address").alias("addresses"))


def disposition_by_day(pihole: DataFrame, last: int = 62) -> DataFrame:
    """Counts of the four dispositions per UTC day, the last `last` days."""
    kinds = ["gravity_blocked", "regex_blocked", "forwarded", "cached"]
    days = pihole.filter("ts IS NOT NULL").groupBy(F.floor(F.col("ts") / DAY).cast("long").alias("day")).agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])
    newest = days.agg(F.max("day").alias("_m"))
    return days.crossJoin(F.broadcast(newest)).filter(F.col("day") > F.col("_m") - last).drop("_m")  # one row on the right


def cadence_gaps(pihole: DataFrame, within: float = 21_600.0, least: int = 20) -> DataFrame:
    """Per (address, name): gaps under six hours; with enough of them their coefficient of variation and median."""
    asked = pihole.filter("event_type = 'query' AND src IS NOT NULL AND ts IS NOT NULL")
    order = Window.partitionBy("src", "query").orderBy("ts", "row_id")
    gaps = asked.withColumn("gap", F.col("ts") - F.lag("ts").over(order)).filter(F.col("gap") < within)
    stats = gaps.groupBy("src", "query").agg(F.count("*").alias("gaps"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"), F.percentile("gap", 0.5).alias("median_gap"))
    enough = F.col("gaps") >= least
    return stats.select("src", "query", "gaps", F.when(enough, F.bround("cv", 6)).alias("cv"), F.when(enough, F.bround("median_gap", 6)).alias("median_gap"))
