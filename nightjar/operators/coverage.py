"""What an export can vouch for: files bound to a manifest, and whether trusted intervals cover a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.operators.windows import merge_intervals

# Objects beyond which none is trusted, and a period's seconds.
MOST_OBJECTS, PERIOD = 100_000, 86_400


def hashed_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(folder, name, size, sha256) of files; contents are hashed in the tasks that read them and stay there."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return read.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def availability(files: DataFrame, manifests: DataFrame, entries: DataFrame, keys: tuple[str, ...] = (), most: int = MOST_OBJECTS) -> DataFrame:
    """files (folder, name, size, sha256, keys) with trusted, reason, starts and ends.

    manifests: folder, state (`ok` or why it can't be used). entries: folder, name, size, sha256, completion, starts, ends. A file is trusted if its
    folder's manifest names it once, as a success, with its very size and digest; its interval is then the entry's, else null. A manifest
    that names a file twice is malformed. Over `most` files of one set (keys) none of them is trusted.
    """
    listed = entries.groupBy("folder", "name").agg(F.count("*").alias("_c"), F.first(F.struct("size", "sha256", "completion", "starts", "ends")).alias("_e"))
    broken = listed.filter("_c > 1").select("folder").distinct().withColumn("_twice", F.lit(True))
    states = manifests.groupBy("folder").agg(F.max(F.struct(F.col("state") != "ok", "state")).alias("_s")).select("folder", F.col("_s.state").alias("_state"))
    found = files.join(states, "folder", "left").join(broken, "folder", "left").join(listed.filter("_c = 1").drop("_c"), ["folder", "name"], "left")
    counts = files.groupBy(*keys).agg(F.count("*").alias("_n"))
    found = found.join(counts, list(keys), "left") if keys else found.crossJoin(F.broadcast(counts))  # one row on the right
    same = (F.col("size") == F.col("_e.size")) & (F.col("sha256") == F.lower("_e.sha256"))
    reason = (
        F.when(F.col("_n") > most, "resource_limit").when(F.col("_state").isNull(), "manifest_missing").when(F.col("_state") != "ok", F.concat(F.lit("manifest_"), F.col("_state")))
        .when(F.col("_twice"), "manifest_malformed").when(F.col("_e").isNull(), "entry_missing").when(~F.col("_e.completion").eqNullSafe("success"), "incomplete")
        .when(~F.coalesce(same, F.lit(False)), "binding_mismatch").otherwise("trusted")
    )
    told = found.withColumn("reason", reason).withColumn("trusted", F.col("reason") == "trusted")
    kept = lambda c: F.when(F.col("trusted"), F.col(f"_e.{c}")).alias(c)
    return told.select(*files.columns, "trusted", "reason", kept("starts"), kept("ends"))


def trusted_spans(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, starts, ends): trusted intervals that overlap or touch, merged."""
    return merge_intervals(facts.filter("trusted AND ends > starts").select(*keys, "starts", "ends"), keys, "starts", "ends").drop("n")


def _within(asked: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, starts, ends, ...) with `held`: whether one span holds the whole of it. Spans are disjoint, so the last that starts by then decides."""
    marks = spans.select(*keys, F.col("starts").alias("_at"), F.lit(0).alias("_kind"), F.col("ends").alias("_reach"))
    both = asked.withColumns({"_at": F.col("starts"), "_kind": F.lit(1), "_reach": F.lit(None).cast(dict(spans.dtypes)["ends"])}).unionByName(marks, allowMissingColumns=True)
    reach = F.last("_reach", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_at", "_kind"))
    return both.withColumn("held", F.coalesce(reach >= F.col("ends"), F.lit(False))).filter("_kind = 1").drop("_at", "_kind", "_reach")


def verdicts(reports: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """reports (keys, starts, ends, ...) with strong and why: strong only if every object of the set is trusted and one merged interval holds the report."""
    valid = F.col("trusted") & F.coalesce(F.col("ends") > F.col("starts"), F.lit(False))
    sets = facts.groupBy(*keys).agg(F.min(valid).alias("_all"))
    told = _within(reports, trusted_spans(facts, keys), keys).join(sets, keys, "left")
    bounded = F.coalesce(F.col("ends") > F.col("starts"), F.lit(False))
    why = F.when(~bounded, "interval_unbounded").when(F.col("_all").isNull(), "no_objects").when(~F.col("_all"), "object_unknown").when(F.col("held"), "complete").otherwise("interval_gap")
    return told.withColumn("why", why).withColumn("strong", F.col("why") == "complete").drop("_all", "held")


def covered_periods(told: DataFrame, facts: DataFrame, keys: list[str], seen: DataFrame) -> DataFrame:
    """(keys, period): 24-hour periods back from a report's end that count as covered, 0 being the last.

    told: verdicts with `since`, where the history starts. For a strong report a period counts if one trusted interval holds it; for a weak one
    the periods in which there are rows do (seen: keys, period).
    """
    whole = F.floor((F.col("ends") - F.coalesce("since", "starts")) / PERIOD).cast("int")
    strong = told.filter("strong").withColumn("_n", whole).filter("_n > 0")
    each = strong.select(*keys, F.col("ends").alias("_end"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("period"))  # days of the history
    each = each.select(*keys, "period", (F.col("_end") - (F.col("period") + 1) * PERIOD).alias("starts"), (F.col("_end") - F.col("period") * PERIOD).alias("ends"))
    held = _within(each, trusted_spans(facts, keys), keys).filter("held").select(*keys, "period")
    return held.unionByName(seen.select(*keys, "period").distinct().join(told.filter("NOT strong").select(*keys), keys, "left_semi"))
