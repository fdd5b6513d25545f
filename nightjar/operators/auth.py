"""Authentication lenses over access decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["host", "gate", "source", "actor"]


def concentration(decisions: DataFrame, least: int = 100, keys: list[str] = KEY) -> DataFrame:
    """Keys with at least `least` denials."""
    denied = decisions.filter("outcome = 'denied'").groupBy(*keys).agg(F.count("*").alias("denials"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return denied.filter(F.col("denials") >= least)


def concentration_near_miss(decisions: DataFrame, least: int = 100) -> DataFrame:
    """One row: keys, keys that fire, and the largest count below the limit."""
    counts = decisions.filter("outcome = 'denied'").groupBy(*KEY).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("keys"), F.count_if(F.col("n") >= least).alias("firing"), F.max(F.when(F.col("n") < least, F.col("n"))).alias("near_miss"))


def fanout(decisions: DataFrame, accounts: int = 5, sources: int = 5) -> DataFrame:
    """Sources denied on many accounts and accounts denied from many sources."""
    denied = decisions.filter("outcome = 'denied' AND source IS NOT NULL AND actor IS NOT NULL AND actor_namespace IS NOT NULL")
    account = F.concat_ws(":", "actor_namespace", "actor")
    by_source = denied.groupBy("source").agg(F.countDistinct(account).alias("breadth"), F.count("*").alias("denials")).select(F.lit("source").alias("kind"), F.col("source").alias("identity"), "breadth", "denials")
    by_actor = denied.groupBy(account.alias("identity")).agg(F.countDistinct("source").alias("breadth"), F.count("*").alias("denials")).select(F.lit("account").alias("kind"), "identity", "breadth", "denials")
    return by_source.filter(F.col("breadth") >= accounts).unionByName(by_actor.filter(F.col("breadth") >= sources))


def volume(decisions: DataFrame, per_day: int = 18, covered_least: int = 100) -> DataFrame:
    """Sources and accounts with many denials for the days covered, less those that a concentration already covers."""
    days = decisions.agg(F.greatest(F.lit(1.0), (F.max("ts") - F.min("ts")) / 86400).alias("days"))
    denied = decisions.filter("outcome = 'denied'")
    entity = F.explode(F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("identity")), F.struct(F.lit("account").alias("kind"), F.col("actor").alias("identity"))))
    counts = denied.select(entity.alias("e")).filter("e.identity IS NOT NULL").groupBy("e.kind", "e.identity").agg(F.count("*").alias("denials"))
    covered = concentration(decisions, covered_least).select(entity.alias("e")).select("e.kind", "e.identity").distinct()
    floor = F.greatest(F.lit(per_day), F.ceil(F.lit(per_day) * F.col("days")))
    return counts.crossJoin(F.broadcast(days)).filter(F.col("denials") >= floor).join(covered, ["kind", "identity"], "left_anti").select("kind", "identity", "denials")  # one row of days


def host_spread(decisions: DataFrame, least: int = 3) -> DataFrame:
    """(source, namespace, actor) denied on several hosts; rows without a source or an actor tell of none, a missing namespace is `unscoped`."""
    denied = _scoped(decisions).filter("outcome = 'denied' AND source IS NOT NULL AND actor IS NOT NULL").groupBy("source", "actor_namespace", "actor")
    return denied.agg(F.countDistinct(F.lower("host")).alias("hosts"), F.count("*").alias("denials")).filter(F.col("hosts") >= least)


def _scoped(decisions: DataFrame) -> DataFrame:
    """With a namespace for each actor."""
    return decisions.withColumn("actor_namespace", F.when(F.col("actor").isNotNull(), F.coalesce("actor_namespace", F.lit("unscoped"))))


def _matching(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys in which a missing value meets a missing value; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def landing_runs(decisions: DataFrame, least: int = 6, keys: list[str] = KEY) -> DataFrame:
    """A run of denials followed by a grant on one key.

    Rows of one instant are a batch; a batch with both outcomes is an unresolved tie. The island of a batch is the
    number of batches with a grant before it, so a run ends with its first grant.
    """
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in keys])
    batches = decisions.filter("ts IS NOT NULL AND outcome IN ('denied', 'granted')").groupBy(*keys, "ts").agg(F.count_if(F.col("outcome") == "denied").alias("denied"), F.count_if(F.col("outcome") == "granted").alias("granted"))
    order = Window.partitionBy(*keys).orderBy("ts")
    islands = batches.withColumn("island", F.coalesce(F.sum((F.col("granted") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = islands.groupBy(*keys, "island").agg(F.sum("denied").alias("denials"), F.max(F.when(F.col("granted") > 0, F.col("ts"))).alias("granted_ts"), F.max((F.col("granted") > 0) & (F.col("denied") > 0)).alias("tie"), F.min("ts").alias("first_ts"))
    landed = runs.filter((F.col("denials") >= least) & F.col("granted_ts").isNotNull())
    later = decisions.filter("outcome = 'denied'").groupBy(*keys).agg(F.max("ts").alias("last_denied"))
    out = landed.join(later, keys, "left").withColumn("state", F.when(F.col("tie"), "tie-unresolved").when(F.coalesce(F.col("last_denied") > F.col("granted_ts"), F.lit(False)), "resumed").otherwise("ceased"))
    return out.withColumn("id", F.substring(F.sha2(F.concat_ws("|", key, "island"), 256), 1, 20)).select(*keys, "denials", "first_ts", "granted_ts", "state", "id")


def firing_facts(decisions: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Uniform facts of the rows behind firing keys: records, denials, accounts, live accounts, hosts, bounds."""
    live = decisions.filter("outcome = 'granted'").select("actor").distinct().withColumn("_live", F.lit(True))
    rows = decisions.join(keys.select(*on), on, "left_semi").join(live, "actor", "left")
    return rows.groupBy(*on).agg(
        F.count("*").alias("records"), F.count_if(F.col("outcome") == "denied").alias("denials"), F.countDistinct("actor").alias("accounts"),
        F.countDistinct(F.when(F.col("_live"), F.col("actor"))).alias("live_accounts"), F.countDistinct("host").alias("hosts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


EDGE, EPISODE = ["source", "actor_namespace", "actor"], [*KEY, "actor_namespace"]


def findings(decisions: DataFrame, concentration_least: int = 100, landing_least: int = 6, spread_least: int = 3, volume_least: int = 18, signals: tuple[str, ...] = ("concentration", "landing", "host_spread", "source_volume", "account_volume"), by_day: bool = True) -> DataFrame:
    """One row per firing lens: signal, identity, severity, denials, landings (absorbed), overlaps (findings of one identity).

    A concentration whose key also landed goes; a host spread absorbs the landings of its (source, namespace, actor); a landing that is an unresolved tie is none;
    a spread and the volume findings of its source or account name each other. A volume's limit is one for each day covered, and identities that
    a concentration covers have no volume finding; without ``by_day`` it is one for all days, for every identity.
    """
    said = lambda *c: F.concat_ws(" ", *c)
    days = decisions.agg(F.greatest(F.lit(1.0), (F.max("ts") - F.min("ts")) / 86400).alias("days"))
    decisions = _scoped(decisions.filter("source IS NOT NULL OR actor IS NOT NULL").withColumn("host", F.lower("host")))
    denied = decisions.filter("outcome = 'denied'")
    landed = landing_runs(decisions, landing_least, EPISODE).filter("state <> 'tie-unresolved'")
    covered = concentration(decisions, concentration_least, EPISODE)
    packed = _matching(covered, landed.select(*EPISODE).distinct(), EPISODE, "left_anti")
    spread = host_spread(decisions, spread_least)
    edges = spread.select(*EDGE).distinct()
    absorbed = _matching(landed, edges, EDGE, "left_semi").groupBy(*EDGE).agg(F.count("*").alias("landings"))
    alone = _matching(landed, edges, EDGE, "left_anti")
    none = F.lit(0).cast("long").alias("landings")
    key = said(*KEY).alias("identity")
    parts = {
        "concentration": packed.select(F.lit("concentration").alias("signal"), key, "denials", none, F.lit(None).cast("string").alias("of_source"), F.lit(None).cast("string").alias("of_actor")),
        "landing": alone.select(F.lit("landing").alias("signal"), key, "denials", none, F.lit(None).cast("string").alias("of_source"), F.lit(None).cast("string").alias("of_actor")),
        "host_spread": _matching(spread, absorbed, EDGE, "left").select(F.lit("host_spread").alias("signal"), said(*EDGE).alias("identity"), "denials", F.coalesce("landings", F.lit(0)).cast("long").alias("landings"), F.col("source").alias("of_source"), said("actor_namespace", "actor").alias("of_actor")),
    }
    for signal, columns, mark in (("source_volume", ["source"], "of_source"), ("account_volume", ["actor_namespace", "actor"], "of_actor")):
        there = denied.filter(" AND ".join(f"{c} IS NOT NULL" for c in columns)).groupBy(*columns).agg(F.count("*").alias("denials"))
        if by_day:
            floor = F.greatest(F.lit(volume_least), F.ceil(F.lit(volume_least) * F.col("days")))
            there = there.crossJoin(F.broadcast(days)).filter(F.col("denials") >= floor).drop("days").join(covered.select(*columns).distinct(), columns, "left_anti")  # one row of days
        else:
            there = there.filter(F.col("denials") >= volume_least)
        names = {"of_source": F.lit(None).cast("string"), "of_actor": F.lit(None).cast("string")} | {mark: said(*columns)}
        parts[signal] = there.select(F.lit(signal).alias("signal"), said(*columns).alias("identity"), "denials", none, *[c.alias(n) for n, c in names.items()])
    rows = None
    for signal in signals:
        rows = parts[signal] if rows is None else rows.unionByName(parts[signal])
    spreads, volumes = rows.filter("signal = 'host_spread'"), rows.filter("signal IN ('source_volume', 'account_volume')")
    pairs = spreads.select(F.col("identity").alias("spread"), F.explode(F.array(F.struct(F.lit("source_volume").alias("signal"), F.col("of_source").alias("identity")), F.struct(F.lit("account_volume").alias("signal"), F.col("of_actor").alias("identity")))).alias("v")).select("spread", "v.signal", "v.identity")
    linked = pairs.join(volumes.select("signal", "identity"), ["signal", "identity"])
    both = linked.select("signal", "identity").unionByName(linked.select(F.lit("host_spread").alias("signal"), F.col("spread").alias("identity"))).groupBy("signal", "identity").agg(F.count("*").alias("overlaps"))
    return rows.join(both, ["signal", "identity"], "left").select("signal", "identity", F.lit("MEDIUM").alias("severity"), "denials", "landings", F.coalesce("overlaps", F.lit(0)).cast("long").alias("overlaps"))
