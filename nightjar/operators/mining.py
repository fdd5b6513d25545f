"""Template mining of log messages, features of DNS rows, connected components, and dense groups of names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.frames import checkpointed, counted
from nightjar.operators.events import masked

ANY = "<*>"


def _put(templates: list[list[str]], tokens: list[str], least: float) -> None:
    """Let a token list join the likeliest template of its length, or open one.

    Likeness is the share of places with equal tokens, open places not counting; of equal ones that with more open places.
    """
    best, found = (least, -1), None
    for i, t in enumerate(templates):
        same = sum(a == b != ANY for a, b in zip(t, tokens, strict=True)) / len(tokens)
        rank = (same, sum(a == ANY for a in t))
        if rank > best or (found is None and rank[0] >= least):
            best, found = rank, i
    if found is None:
        templates.append(list(tokens))
    else:
        templates[found] = [a if a == b else ANY for a, b in zip(templates[found], tokens, strict=True)]


def _merged(messages: list[list[str]], least: float) -> list[list[str]]:
    """Templates of token lists of one length, put in order."""
    templates: list[list[str]] = []
    for tokens in messages:
        _put(templates, tokens, least)
    return templates


def _bucket(tokens: Column, leading: int) -> Column:
    """The path of a message in the prefix tree: its length, then its leading tokens, those with a digit being open."""
    heads = [F.when(F.get(tokens, F.lit(i)).rlike(r"\d"), ANY).otherwise(F.get(tokens, F.lit(i))) for i in range(leading)]
    return F.concat_ws(" ", F.size(tokens).cast("string"), *heads)


def _grow(batches: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """A task's partial tree from its rows (_bucket, _masked, _first), bucket by bucket in order: its leaves' templates, not its messages, are held."""
    bucket, open_, first = None, [], []
    for batch in batches:
        out = []
        for name, masked_, at in zip(batch["_bucket"], batch["_masked"], batch["_first"], strict=True):
            if name != bucket:
                out += [(bucket, " ".join(t), f) for t, f in zip(open_, first, strict=True)]
                bucket, open_, first = name, [], []
            known = len(open_)
            _put(open_, masked_.split(" "), least)
            if len(open_) > known:
                first.append(at)
        yield pd.DataFrame(out, columns=["_bucket", "template", "_first"])
    yield pd.DataFrame([(bucket, " ".join(t), f) for t, f in zip(open_, first, strict=True)], columns=["_bucket", "template", "_first"])


def mine_templates(rows: DataFrame, message: str = "message", least: float = 0.5, leading: int = 2) -> DataFrame:
    """rows with `template`, by a prefix tree of fixed depth: length, leading tokens, then templates of a least likeness.

    Messages are masked and made distinct, and dealt by their text, so that a leaf with very many messages is grown in many tasks. The partial
    trees' templates of a leaf then meet and are merged in the order of (first time, text) as messages are, so reruns agree. A message takes
    the template of its leaf that fits it with most fixed tokens, then the first in order. A null message has no template.
    """
    text = rows.withColumn("_masked", F.trim(F.regexp_replace(masked(F.col(message)), r"\s+", " ")))
    distinct = text.filter("_masked IS NOT NULL").groupBy("_masked").agg(F.min("ts").alias("_first"))
    keyed = checkpointed(distinct.withColumn("_tokens", F.split("_masked", " ")).withColumn("_bucket", _bucket(F.col("_tokens"), leading)))
    order = [F.col("_bucket"), F.col("_first").asc_nulls_last(), F.col("_masked")]
    dealt = keyed.select("_bucket", "_masked", "_first").repartition("_masked").sortWithinPartitions(*order)
    partial = dealt.mapInPandas(lambda batches: _grow(batches, least), "_bucket string, template string, _first double").filter("_bucket IS NOT NULL")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_first", "template"], na_position="last")
        merged = _merged([t.split(" ") for t in part["template"]], least)
        return pd.DataFrame({"_bucket": part["_bucket"].iloc[0], "template": [" ".join(t) for t in merged], "place": range(len(merged))})

    leaves = partial.groupBy("_bucket").applyInPandas(merge, "_bucket string, template string, place int")
    listed = counted(leaves.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct("place", "template"))).alias("_leaf")))
    fixed = lambda parts: F.size(F.filter(parts, lambda t: t != ANY))
    fits = lambda t: F.forall(F.zip_with(F.split(t, " "), "_tokens", lambda a, b: (a == ANY) | (a == b)), lambda x: x)
    best = F.array_max(F.transform(F.filter("_leaf", lambda x: fits(x["template"])), lambda x: F.struct(fixed(F.split(x["template"], " ")).alias("fixed"), (-x["place"]).alias("place"), x["template"].alias("template"))))
    found = keyed.join(listed, "_bucket").select("_masked", F.coalesce(best["template"], "_masked").alias("template"))
    return text.join(found, "_masked", "left").drop("_masked")


def dns_features(dns: DataFrame, suffixes: int = 20) -> DataFrame:
    """Per row: standardised log rtt (median where missing, with a flag), log summed TTL, lengths, labels, answers, truncation, and the last label if it is one of the commonest."""
    labels = F.filter(F.split(F.regexp_replace(F.lower(F.trim("query")), r"\.+$", ""), r"\."), lambda x: x != "")
    base = dns.withColumn("_labels", labels)
    last = F.coalesce(F.get("_labels", F.size("_labels") - 1), F.lit(""))
    second = F.coalesce(F.get("_labels", F.size("_labels") - 2), F.lit(""))
    rtt = F.when(F.col("rtt") >= 0, F.log1p("rtt"))
    ttl = F.log1p(F.greatest(F.lit(0.0), F.aggregate(F.coalesce("ttl", F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))))
    plain = base.select(
        "row_id", "query", rtt.alias("rtt"), rtt.isNull().cast("double").alias("rtt_missing"), ttl.alias("ttl"), F.length(F.array_join("_labels", ".")).cast("double").alias("length"), F.size("_labels").cast("double").alias("parts"),
        F.length(last).cast("double").alias("suffix_len"), F.length(second).cast("double").alias("domain_len"), F.coalesce(F.size("answer"), F.lit(0)).cast("double").alias("answers"), F.coalesce("tc", F.lit(False)).cast("double").alias("tc"), last.alias("suffix"),
    )
    median = plain.agg(F.percentile("rtt", 0.5).alias("_m"))
    filled = plain.crossJoin(F.broadcast(median)).withColumn("rtt", F.coalesce("rtt", "_m", F.lit(0.0))).drop("_m")  # one row on the right
    top = plain.groupBy("suffix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(suffixes).select(F.col("suffix").alias("_top"))
    named = filled.join(F.broadcast(top), F.col("suffix") == F.col("_top"), "left").withColumn("suffix", F.coalesce("_top", F.lit("other"))).drop("_top")  # at most `suffixes` rows
    numbers = ("rtt", "rtt_missing", "ttl", "length", "parts", "suffix_len", "domain_len", "answers", "tc")
    scale = named.agg(*[F.avg(c).alias(f"_a_{c}") for c in numbers], *[F.stddev_pop(c).alias(f"_s_{c}") for c in numbers])
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in numbers}
    return named.crossJoin(F.broadcast(scale)).select("row_id", "query", "suffix", *[e.alias(c) for c, e in scaled.items()])  # one row on the right


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, label) of links that fit into a task."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(up), "label": [top(x) for x in list(up)]}, dtype="int64")


def components(pairs: DataFrame, rounds: int = 200, in_one_task: int = 500_000) -> DataFrame:
    """Links (a, b) of longs -> (node, label): the smallest node reachable.

    Labels run ahead along the links and jump to their label's own, round by round; links that are counted to be at most ``in_one_task`` are joined in one.
    """
    links = checkpointed(pairs.distinct())
    if links.count() <= in_one_task:
        return checkpointed(links.coalesce(1).mapInPandas(_joined, "node long, label long"))
    links = checkpointed(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(rounds):
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        # the label's own label: paths halve, as in pointer jumping
        jumped = lower.join(lower.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label", "left").select("node", F.least("label", F.coalesce("_next", "label")).alias("label"), "moved")
        labels = checkpointed(jumped)
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("moved")
    raise RuntimeError("the components did not settle")


def dense_scan(clustered: DataFrame, score: Column, least: int = 100, high: float = 1.8, high_share: float = 0.8, domain_share: float = 0.8, top: int = 500) -> DataFrame:
    """High-scoring names of clusters that look like one domain's tunnel: large, mostly high-scoring, mostly one domain.

    A name counts for the first of its clusters; of all surfaced names the `top` by score stay.
    """
    rows = clustered.filter("cluster >= 0").withColumn("score", score)
    is_high = F.col("score") >= high
    domains = rows.groupBy("cluster", "domain").agg(F.count("*").alias("n"), F.count(is_high).alias("scored"), F.count_if(is_high).alias("above"))
    whole = Window.partitionBy("cluster")  # a row a domain
    lead = domains.withColumns({"_r": F.row_number().over(whole.orderBy(F.desc("n"), "domain")), "size": F.sum("n").over(whole), "high": F.sum("above").over(whole) / F.sum("scored").over(whole)})
    good = lead.filter("_r = 1").withColumnRenamed("domain", "dominant").filter((F.col("size") >= least) & (F.col("high") >= high_share) & (F.col("n") >= domain_share * F.col("size")))
    names = rows.join(counted(good.select("cluster", "dominant")), "cluster").filter(F.col("score") >= high)
    claimed = names.groupBy("query").agg(F.min(F.struct("cluster", "dominant")).alias("c"), F.max("score").alias("score"), F.count("*").alias("rows"))
    best = claimed.orderBy(F.desc(F.bround("score", 9)), "query").limit(top)  # a report of the best ones
    return best.select("query", F.col("c.cluster").alias("cluster"), F.col("c.dominant").alias("domain"), F.bround("score", 6).alias("score"), "rows")
