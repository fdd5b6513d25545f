"""Flow cube: (src, dst, service, bin) -> metric, with durations spread over bins and rare identities folded."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.frames import counted

# Bin widths in seconds that read well on a clock.
WIDTHS = (1, 5, 10, 30, 60, 300, 900, 1800, 3600, 7200, 21_600, 43_200, 86_400, 604_800)
# Hosts and services of a cube, its flows, and its cells.
HOSTS, SERVICES, FLOWS, CELLS = 30, 16, 4000, 750_000
OTHER = "(other)"


def prepare(conn: DataFrame) -> DataFrame:
    """Connection rows as (ts, src, dst, svc, metric, duration)."""
    service = F.concat_ws("/", F.coalesce(F.col("port").cast("string"), F.lit("?")), F.coalesce("proto", F.lit("?")))
    return conn.filter("ts IS NOT NULL").select("row_id", "ts", "src", "dst", service.alias("svc"), F.greatest(F.coalesce("bytes", F.lit(0)), F.lit(0)).cast("double").alias("metric"), F.greatest(F.coalesce("duration", F.lit(0.0)), F.lit(0.0)).alias("duration"))


def pick_bin(span: float, target: int) -> int:
    """The least width that covers a span, both ends included, in at most `target` bins; beyond a week, whole weeks."""
    week, need = WIDTHS[-1], max(span, 1.0) / max(target - 1, 1)
    if target == 1:  # the last second must not open a second bin
        return next((w for w in WIDTHS if w > need), (math.floor(need / week) + 1) * week)
    return next((w for w in WIDTHS if w >= need), math.ceil(need / week) * week)


def spread(rows: DataFrame, width: float, until: float | None = None) -> DataFrame:
    """(src, dst, svc, bin): the metric in proportion to each bin's overlap with the duration, counts at the start.

    With `until` no bin after it is made, and what a duration has there isn't shown: so a corrupt duration makes no more bins than the span has.
    """
    first, end = F.floor(F.col("ts") / width), F.col("ts") + F.col("duration")
    last = F.greatest(first, F.ceil(end / width) - 1)
    if until is not None:
        last = F.greatest(first, F.least(last, F.lit(math.floor(until / width)).cast("long")))
    each = rows.withColumn("_first", first).withColumn("bin", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("ts") + F.col("duration"), (F.col("bin") + 1) * width) - F.greatest(F.col("ts"), F.col("bin") * width)
    part = F.when(F.col("duration") > 0, F.col("metric") * overlap / F.col("duration")).otherwise(F.col("metric"))
    return each.groupBy("src", "dst", "svc", "bin").agg(F.sum(part).alias("metric"), F.count_if(F.col("bin") == F.col("_first")).alias("rows"))


def _kept(cells: DataFrame, name: str, most: int) -> DataFrame:
    """(name, rank): the `most` identities of a dimension by metric, then rows, then name."""
    order = [F.desc(F.bround("_m", 6)), F.desc("_n"), F.col(name)]
    totals = cells.filter(F.col(name).isNotNull()).groupBy(name).agg(F.sum("metric").alias("_m"), F.sum("rows").alias("_n"))
    return totals.orderBy(*order).limit(most).select(F.col(name).alias("_kept"), F.row_number().over(Window.orderBy(*order)).alias("_rank"))  # at most `most` rows


def fold_rare(cells: DataFrame, top: int = 20, services: int | None = None) -> DataFrame:
    """Identities outside the `top` of each dimension (of services: `services`) by metric, then rows, become (other)."""
    out = cells
    for name in ("src", "dst", "svc"):
        kept = _kept(cells, name, services if name == "svc" and services else top).drop("_rank")
        out = out.join(F.broadcast(kept), F.col(name) == F.col("_kept"), "left").withColumn(name, F.coalesce("_kept", F.lit(OTHER))).drop("_kept")  # at most `top` rows
    return out.groupBy("src", "dst", "svc", "bin").agg(F.sum("metric").alias("metric"), F.sum("rows").alias("rows"))


def ranked(rows: DataFrame, hosts: int, services: int) -> DataFrame:
    """rows (src, dst, svc, metric, rows) with _src, _dst, _svc: an identity's rank in its dimension, one over the limit for all beyond it."""
    out = rows
    for name, most in (("src", hosts), ("dst", hosts), ("svc", services)):
        out = out.join(F.broadcast(_kept(rows, name, most).withColumnRenamed("_rank", f"_{name}")), F.col(name) == F.col("_kept"), "left").drop("_kept")  # at most `most` rows
        out = out.withColumn(f"_{name}", F.coalesce(f"_{name}", F.lit(most + 1)))
    return out


def limit_curve(places: DataFrame, vary: str, hosts: int, services: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(limit, groups): how many groups (src, dst, svc and `by`) a fold leaves at each limit, for all limits of one kind in one pass.

    places: _src, _dst, _svc from `ranked`. vary: `services` from 1 to services with hosts held, or `hosts` from 1 to hosts with services held. A
    group of the fold is there for an unbroken stretch of limits, so it is one step up and one step down; a running sum over steps is the curve.
    """
    s, d, v = F.col("_src"), F.col("_dst"), F.col("_svc")
    stretch = lambda groups, lo, hi: groups.filter(lo < hi).select(F.explode(F.array(F.struct(lo.alias("limit"), F.lit(1).alias("step")), F.struct(hi.alias("limit"), F.lit(-1).alias("step")))).alias("e")).select("e.*")
    zero = F.lit(0)
    if vary == "services":
        most = services
        each = places.select(F.least(s, F.lit(hosts + 1)).alias("_src"), F.least(d, F.lit(hosts + 1)).alias("_dst"), "_svc", *by).distinct()
        parts = [each.select(v.alias("limit"), F.lit(1).alias("step")), stretch(each.groupBy("_src", "_dst", *by).agg(F.max("_svc").alias("hi")), zero, F.col("hi"))]
    else:
        most = hosts
        each = places.select("_src", "_dst", F.least(v, F.lit(services + 1)).alias("_svc"), *by).distinct()
        parts = [each.select(F.greatest(s, d).alias("limit"), F.lit(1).alias("step")), stretch(each.groupBy("_svc", *by).agg(F.max(F.least(s, d)).alias("hi")), zero, F.col("hi"))]
        parts += [stretch(each.groupBy(near, "_svc", *by).agg(F.max(far).alias("hi")), F.col(near), F.col("hi")) for near, far in (("_src", "_dst"), ("_dst", "_src"))]
    steps = parts[0]
    for part in parts[1:]:
        steps = steps.unionByName(part)
    steps = steps.groupBy("limit").agg(F.sum("step").alias("step"))
    limits = places.sparkSession.range(0, most + 1).select(F.col("id").cast("int").alias("limit"))
    running = F.sum(F.coalesce("step", F.lit(0))).over(Window.orderBy("limit").rowsBetween(Window.unboundedPreceding, 0))  # one row a limit
    return limits.join(F.broadcast(steps), "limit", "left").select("limit", running.alias("groups")).filter("limit >= 1")  # at most one row a limit


@dataclass(frozen=True)
class Fit:
    """Limits, width in seconds and start that a cube was folded with."""

    hosts: int
    services: int
    width: int
    start: float | None


def _limits(places: DataFrame, hosts: int, services: int, budget: int, by: tuple[str, ...] = ()) -> tuple[int, int]:
    """The most services whose fold has `budget` groups at most; if not even one has, one service and the most hosts, at least one."""
    largest = lambda vary, v: limit_curve(places, vary, hosts, v, by).filter(F.col("groups") <= budget).agg(F.max("limit")).first()[0]  # noqa: E731  one row
    fit = largest("services", services)
    return (hosts, fit) if fit is not None else (largest("hosts", 1) or 1, 1)


def fit_budget(rows: DataFrame, width: int, hosts: int = HOSTS, services: int = SERVICES, flows: int = FLOWS, cells: int = CELLS) -> tuple[DataFrame, Fit]:
    """Folded cells within a budget of flows and one of cells, and what was chosen for it; bins count from the first row.

    First fewer services, then fewer hosts, until flows fit; then wider bins until cells fit; at one bin for the whole span, fewer services and hosts
    again. One host and one service always fit by flows (at most eight). Ranks don't depend on the width, so identities are ranked once, and a
    try is a count; there are at most as many as WIDTHS. No bin is made after that of the last row.
    rows: src, dst, svc, ts, duration, metric.
    """
    lo, hi = rows.agg(F.min("ts"), F.max("ts")).first()  # one row
    start, span = (0.0, 0.0) if lo is None else (lo, hi - lo)
    places = ranked(rows.withColumns({"rows": F.lit(1), "ts": F.col("ts") - F.lit(start)}), hosts, services)
    flat = places.select("_src", "_dst", "_svc").distinct()
    h, v = _limits(flat, hosts, services, flows)

    def made(h: int, v: int, w: int) -> DataFrame:
        named = [F.when(F.col(f"_{name}") <= most, F.col(name)).otherwise(F.lit(OTHER)).alias(name) for name, most in (("src", h), ("dst", h), ("svc", v))]
        return spread(places.select(*named, "ts", "duration", "metric"), float(w), span)

    last = max(pick_bin(span, 1), width)
    for w in [width, *[u for u in WIDTHS if width < u < last], *([last] if last > width else [])]:
        out = made(h, v, w)
        if out.count() <= cells:
            return out, Fit(h, v, w, lo)
    h, v = _limits(flat, h, v, cells)  # one bin holds everything: cells are flows
    return made(h, v, last), Fit(h, v, last, lo)


def saturate(cells: DataFrame, limit: float = 3.4028234663852886e38) -> DataFrame:
    """Cells clipped to the limit, and scaled down in bins whose sum is over it; altered says which."""
    clipped = cells.withColumn("_c", F.least(F.col("metric"), F.lit(limit)))
    whole = F.sum(F.col("_c") / limit).over(Window.partitionBy("bin"))
    scaled = F.when(whole > 1, F.col("_c") / whole).otherwise(F.col("_c"))
    return clipped.withColumn("_s", scaled).withColumn("altered", F.col("_s") != F.col("metric")).withColumn("metric", F.col("_s")).drop("_c", "_s")


def merge_cells(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Count cells and byte cells of one cube together, nothing as 0: one aggregate of their union."""
    keys = ["src", "dst", "svc", "bin"]
    both = counts.select(*keys, F.col("rows"), F.lit(0.0).alias("metric")).unionByName(weights.select(*keys, F.lit(0).cast("long").alias("rows"), "metric"))
    return both.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("metric").alias("metric"))


# Least bins with rows, share of a dense bin's rows, bins of a tail, and its rows' greatest share as one in so many.
DENSE_BINS, DENSITY, TAIL_BINS, MASS = 8, 0.05, 6, 1000


def trim_sparse_edges(rows: DataFrame, width: float, least_bins: int = DENSE_BINS) -> DataFrame:
    """rows (ts, duration) without thin outer runs: what starts between the first and the last dense bin, or reaches into them.

    A bin is dense with 5 % of the upper quartile of the rows of bins that have any. A tail under six bins stays, and if the tails have over a
    thousandth of all rows, everything does. Bins are counted once; the bounds are one row.
    """
    first = rows.agg(F.min("ts").alias("_t0"))
    binned = rows.filter("ts IS NOT NULL").crossJoin(F.broadcast(first)).withColumn("_bin", F.floor((F.col("ts") - F.col("_t0")) / width).cast("long"))  # one row on the right
    counts = binned.groupBy("_bin").agg(F.count("*").alias("n"))
    dense = counts.agg(F.percentile("n", 0.75).alias("q"), F.count("*").alias("bins"), F.sum("n").alias("total"), F.max("_bin").alias("last"))
    marked = counts.crossJoin(F.broadcast(dense))  # one row on the right
    ends = marked.agg(
        F.min(F.when(F.col("n") >= F.col("q") * DENSITY, F.col("_bin"))).alias("lo"), F.max(F.when(F.col("n") >= F.col("q") * DENSITY, F.col("_bin"))).alias("hi"),
        F.max("bins").alias("bins"), F.max("total").alias("total"), F.max("last").alias("last"),
    )
    ends = ends.select("bins", "total", "last", F.when(F.col("lo") < TAIL_BINS, 0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("last") - F.col("hi") < TAIL_BINS, F.col("last")).otherwise(F.col("hi")).alias("hi"))
    gone = counts.crossJoin(F.broadcast(ends)).groupBy("bins", "total", "last", "lo", "hi").agg(F.sum(F.when((F.col("_bin") < F.col("lo")) | (F.col("_bin") > F.col("hi")), F.col("n")).otherwise(0)).alias("gone"))  # one row on the right
    whole = (F.col("bins") < least_bins) | (F.col("gone") * MASS > F.col("total"))
    span = gone.select(F.when(whole, 0).otherwise(F.col("lo")).alias("_lo"), F.when(whole, F.col("last")).otherwise(F.col("hi")).alias("_hi"))
    start = F.col("_t0") + F.col("_lo") * width
    reaches = (F.col("_lo") > 0) & (F.col("ts") < start) & (F.col("duration") > 0) & (F.col("ts") + F.col("duration") > start)
    return binned.crossJoin(F.broadcast(span)).filter(F.col("_bin").between(F.col("_lo"), F.col("_hi")) | F.coalesce(reaches, F.lit(False))).drop("_t0", "_bin", "_lo", "_hi")  # one row on the right


UNATTRIBUTED = "(unattributed)"
# How a name was handled, by event.
DISPOSITIONS = {"gravity_blocked": "blocked", "regex_blocked": "blocked", "cached": "cached", "forwarded": "forwarded", "config": "local"}


def disposition(event: Column) -> Column:
    """How an event handled its name; null for others."""
    return F.coalesce(*[F.when(F.lower(event) == name, said) for name, said in DISPOSITIONS.items()])


def attribute(asked: DataFrame, handled: DataFrame, domain: str = "domain") -> DataFrame:
    """Queries fanned out over how their domain's names were handled, mass preserved: asked with svc and metric.

    asked has ``domain``. handled: query, disposition, ts and ``domain``; the same handling of a name within a second counts once. A query's
    weights are its domain's shares and sum to 1; one whose domain was never handled, or that has none, is (unattributed) with weight 1.
    """
    once = handled.filter(F.col("disposition").isNotNull() & F.col(domain).isNotNull()).select(domain, "query", "disposition", F.floor("ts").alias("_s")).distinct()
    counts = once.groupBy(domain, "disposition").agg(F.count("*").alias("_n"))
    shares = counts.withColumn("metric", F.col("_n") / F.sum("_n").over(Window.partitionBy(domain)))
    shares = counted(shares.select(domain, F.col("disposition").alias("svc"), "metric"))
    return asked.join(shares, domain, "left").withColumns({"svc": F.coalesce("svc", F.lit(UNATTRIBUTED)), "metric": F.coalesce("metric", F.lit(1.0))})


def measures(cells: DataFrame, answered: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series, flows and identities of a cube, ready to be drawn.

    cells: src, dst, svc, bin, metric, rows. answered: src, dst, svc, orig, resp. Series have one row a cell with the share of its bin's
    total. Flows have totals, the responder's share of what was measured both ways, and the colour of their service: its rank by total.
    Identities of each side stand in the order of the weighted mean place of whom they talk to, places of the other side being ranks by total.
    """
    whole = Window.partitionBy("bin")
    series = cells.withColumn("bin_total", F.sum("metric").over(whole)).withColumn("share", F.when(F.col("bin_total") > 0, F.col("metric") / F.col("bin_total")))
    flows = cells.groupBy("src", "dst", "svc").agg(F.sum("metric").alias("metric"), F.sum("rows").alias("rows"), F.count("*").alias("bins"))
    # ranks of identities after folding: as many rows as the fold's limits let through
    rank = lambda name: flows.groupBy(name).agg(F.sum("metric").alias("_m")).select(name, F.row_number().over(Window.orderBy(F.desc(F.bround("_m", 6)), name)).alias("_r"))
    both = F.col("orig") + F.col("resp")
    back = answered.groupBy("src", "dst", "svc").agg(F.sum("orig").alias("orig"), F.sum("resp").alias("resp")).select("src", "dst", "svc", F.when(both > 0, F.col("resp") / both).alias("response_share"))
    coloured = flows.join(rank("svc").withColumnRenamed("_r", "colour"), "svc").join(back, ["src", "dst", "svc"], "left")

    def placed(side: str, other: str) -> DataFrame:
        far = flows.groupBy(side, other).agg(F.sum("metric").alias("w")).join(rank(other), other)
        centre = far.groupBy(side).agg(F.sum("w").alias("total"), (F.sum(F.col("w") * F.col("_r")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("centre"))
        order = Window.orderBy(F.bround("centre", 6).asc_nulls_last(), F.desc(F.bround("total", 6)), side)
        return centre.select(F.lit(side).alias("side"), F.col(side).alias("identity"), "total", "centre", F.row_number().over(order).alias("place"))

    return series, coloured, placed("src", "dst").unionByName(placed("dst", "src"))
