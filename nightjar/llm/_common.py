"""Shared Spark building blocks: lineage cuts, range buckets, global row numbers, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from the session's spark.checkpoint.dir.

    Where that is unset a temporary folder is set on one machine (local mode); on a cluster executors
    could not read it, which is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, buckets: int) -> list[int]:
    """At most buckets - 1 rising cut points of a long column, from Spark's quantile sketch.

    The list's length is bounded by the parameter, not by the data.
    """
    if buckets < 2:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.stat.approxQuantile(column, probabilities, 1 / (4 * buckets))
    return sorted({min(max(int(x), LONG_MIN), LONG_MAX) for x in found})  # a double near the end of the range may lie beyond it


def range_bucket(x: Column, bounds: list[int]) -> Column:
    """How many bounds are <= x: a binary search over a literal array, log2(n) steps a row."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    width = sum(steps)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds + [LONG_MAX] * (width - len(bounds))])
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(F.element_at(cuts, at + step) <= x, at + step).otherwise(at)
    )
    return F.least(found, F.lit(len(bounds)))


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 0.. in the given order without ever bringing them into one task.

    Rows are dealt by range of all the order columns, so a frequent key is split (they are pinned first, as
    sampling the ranges reads them once more). The sorted rows are pinned,
    each partition is counted, and the counts' running sum (one row a partition) is joined back.
    """
    spark = df.sparkSession
    ordered = pinned(df).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = pinned(ordered.withColumn("_at", F.monotonically_increasing_id()))
    # monotonically_increasing_id is (partition << 33) + place in the partition
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def connected_components(links: DataFrame, max_rounds: int = 100, in_one_task: int = 10_000) -> DataFrame:
    """Links (a, b) of longs -> (node, component), component being the smallest node that can be reached.

    Each round draws a random order, every node hooks to the first of itself and its neighbours, and the links
    are contracted to the hooks. That leaves a constant share of the nodes on paths and one or two rounds' work
    on stars, so the rounds grow with the logarithm of the nodes. Once the contracted links are counted to be at
    most ``in_one_task``, one task ends the work. Nodes without links are not returned.
    """
    live = pinned(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hooks: list[DataFrame] = []
    while left := live.count():
        if left <= in_one_task:
            hooks.append(pinned(live.coalesce(1).mapInArrow(_settle, "node long, parent long")))
            break
        if len(hooks) == max_rounds:
            raise RuntimeError("the components did not settle")
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("draw"), F.col(c).alias("node"))  # noqa: E731, B023
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(drawn("b")).alias("m")).select(F.col("a").alias("node"), F.least(drawn("a"), "m")["node"].alias("parent"))
        hook = pinned(first)
        hooks.append(hook)
        of_a = hook.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = hook.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = live.join(of_a, "a").join(of_b, "b").filter("pa <> pb")
        live = pinned(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not hooks:
        return links.sparkSession.createDataFrame([], "node long, component long")
    found = hooks[0].withColumnRenamed("parent", "root")
    for hook in hooks[1:]:
        found = found.join(hook.select(F.col("node").alias("root"), F.col("parent").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = pinned(found)
    low = pinned(found.groupBy("root").agg(F.min("node").alias("component")))  # apart from the join, so that AQE can split a hot root
    return found.join(low, "root").select("node", "component")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node of its component) for links that fit into a task."""
    whole = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    a, b = whole["a"].to_numpy(), whole["b"].to_numpy()
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(np.arange(len(nodes)), places[: len(a)], places[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "parent"])


def forest(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the sets of left[i] and right[i], in place; parent[i] <= i, and roots are the smallest members."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent[:] = above


_SHIFTS = tuple(np.uint64(n) for n in (30, 27, 31))
_TIMES = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps), element by element, into a new array."""
    out = x >> _SHIFTS[0]
    out ^= x
    out *= _TIMES[0]
    out ^= out >> _SHIFTS[1]
    out *= _TIMES[1]
    out ^= out >> _SHIFTS[2]
    return out


def broadcast_if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``most`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
