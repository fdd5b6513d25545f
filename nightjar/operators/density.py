"""Hierarchical density clustering over distinct weighted vectors, as Spark jobs.

Core distances and the spanning tree of mutual reachability come from joins over grid cells whose width doubles: at
each width all links of at most that length are there, so that the tree grows in order of length, Borůvka rounds joining what
one width links. Cells around which everything is one component already take no part. The tree's edges are then
merged in rising order, band by band of bounded size, to a condensed tree of clusters of a least weight, and those
of greatest stability are chosen. Merges at one distance are simultaneous, so ties have one result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.frames import checkpointed, counted
from nightjar.operators.mining import components

#: Features that make up a cell; the others only count in distances
GRID = 3
#: Edges that one task links or merges at once
IN_ONE_TASK = 500_000
NODE = "kind string, node long, size long, cluster long, acc double, parent long, birth double"


def _cells(points: DataFrame, width: float, dims: int) -> DataFrame:
    return points.withColumn("cell", F.array(*[F.floor(F.col("v")[i] / width).cast("long") for i in range(dims)]))


def _around(dims: int) -> Column:
    """The cells beside a row's cell and itself."""
    return F.explode(F.array(*[F.array(*[F.col("cell")[i] + d for i, d in enumerate(step)]) for step in product((-1, 0, 1), repeat=dims)]))


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def core_distances(points: DataFrame, samples: int, width: float, dims: int) -> DataFrame:
    """points (id, v, n) with core: the distance within which a point, itself included, has ``samples`` rows."""
    least = min(samples, points.agg(F.sum("n")).first()[0] or 0)
    pending, done = points, []
    while True:
        near = _cells(pending, width, dims).withColumn("at", _around(dims)).select("id", "v", "at")
        others = _cells(points, width, dims).select(F.col("v").alias("w"), F.col("n").alias("m"), F.col("cell").alias("at"))
        there = near.join(others, "at").withColumn("d", _distance("v", "w")).filter(F.col("d") <= width).groupBy("id", "d").agg(F.sum("m").alias("m"))
        upto = Window.partitionBy("id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        found = checkpointed(there.withColumn("sum", F.sum("m").over(upto)).filter(F.col("sum") >= least).groupBy("id").agg(F.min("d").alias("core")))
        done.append(found)
        pending = checkpointed(pending.join(found, "id", "left_anti"))
        if not pending.count():
            break
        width *= 2
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    return checkpointed(points.join(whole, "id"))


def _lightest(edges: DataFrame) -> DataFrame:
    """Of the edges (p, q, w, a, b) between two components the first by weight, then ends."""
    best = edges.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
    return best.select("p", "q", "e.w", "e.a", "e.b")


def _one_task_forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    edges = pd.concat(list(parts) or [pd.DataFrame(columns=["p", "q", "w", "a", "b"])]).sort_values(["w", "a", "b"])
    root: dict[int, int] = {}
    kept = []
    for row in edges.itertuples(index=False):
        p, q = _find(root, row.p), _find(root, row.q)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append(row)
    yield pd.DataFrame(kept, columns=["p", "q", "w", "a", "b"])


def _find(root: dict[int, int], x: int) -> int:
    while (up := root.get(x, x)) != x:
        root[x] = root.get(up, up)
        x = up
    return x


def lightest_forest(edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """The spanning forest of least weight of edges (p, q, w, a, b) over p and q: Borůvka rounds until one task can take the rest.

    In a round every component takes its first edge by (weight, ends); the components so joined are contracted and of parallel edges the first stays.
    """
    live, chosen = checkpointed(_lightest(edges.filter("p <> q"))), []
    shape = live.schema
    while (count := live.count()) > 0:
        if count <= in_one_task:
            chosen.append(live.coalesce(1).mapInPandas(_one_task_forest, shape))
            break
        both = live.unionAll(live.select(F.col("q").alias("p"), F.col("p").alias("q"), "w", "a", "b"))
        picked = both.groupBy("p").agg(F.min(F.struct("w", "a", "b", "q")).alias("e")).select("p", "e.q", "e.w", "e.a", "e.b")
        picked = checkpointed(_lightest(picked))
        chosen.append(picked)
        label = components(picked.select(F.col("p").alias("a"), F.col("q").alias("b")), in_one_task=in_one_task)
        moved = live
        for side in ("p", "q"):
            moved = moved.join(label.select(F.col("node").alias(side), F.col("label").alias("_l")), side, "left").withColumn(side, F.coalesce("_l", side)).drop("_l")
        live = checkpointed(_lightest(moved.select("p", "q", "w", "a", "b").filter("p <> q")))
    if not chosen:
        return live
    forest = chosen[0]
    for part in chosen[1:]:
        forest = forest.unionByName(part)
    return checkpointed(forest)


def spanning_tree(points: DataFrame, width: float, dims: int, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """The edges (w, a, b) of a spanning tree of least mutual-reachability distance over points (id, v, core)."""
    placed, tree = points.select("id", "v", "core", F.col("id").alias("comp")), []
    while True:
        celled = _cells(placed, width, dims)
        cells = celled.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        beside = cells.withColumn("at", _around(dims)).groupBy("at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select(F.col("at").alias("cell"))
        edge = celled.filter(F.col("core") <= width).join(beside, "cell", "left_semi")
        one = edge.withColumn("at", _around(dims)).select("at", F.col("id").alias("a"), F.col("v").alias("x"), F.col("core").alias("c"), F.col("comp").alias("p"))
        two = edge.select(F.col("cell").alias("at"), F.col("id").alias("b"), F.col("v").alias("y"), F.col("core").alias("e"), F.col("comp").alias("q"))
        links = one.join(two, "at").filter("p < q").withColumn("w", F.greatest(_distance("x", "y"), "c", "e")).filter(F.col("w") <= width)
        found = lightest_forest(links.select("p", "q", "w", "a", "b"), in_one_task)
        tree.append(found.select("w", "a", "b"))
        if not found.isEmpty():
            label = components(found.select(F.col("p").alias("a"), F.col("q").alias("b")), in_one_task=in_one_task)
            placed = placed.join(label.select(F.col("node").alias("comp"), "label"), "comp", "left").withColumn("comp", F.coalesce("label", "comp")).select("id", "v", "core", "comp")
            placed = checkpointed(placed)
            bounds = placed.agg(F.min("comp"), F.max("comp")).first()
            if bounds[0] == bounds[1]:
                break
        width *= 2
    whole = tree[0]
    for more in tree[1:]:
        whole = whole.unionAll(more)
    return checkpointed(whole)


def _merge(edges: pd.DataFrame, nodes: pd.DataFrame, least: int, floor: float) -> pd.DataFrame:
    """Merge one component's edges in rising order: its node as it is then, the nodes that left, and the clusters that ended below another."""
    size = dict(zip(nodes["node"], nodes["size"], strict=True))
    held = {n: (int(c), a) for n, c, a in zip(nodes["node"], nodes["cluster"], nodes["acc"], strict=True) if pd.notna(c)}
    loose = {n: [n] for n in size if n not in held}
    root: dict[int, int] = {}
    out: list[tuple] = []
    edges = edges.sort_values(["w", "eid"])
    for w, group in edges.groupby("w", sort=True):
        rate = 1.0 / max(w, floor)
        local: dict[int, int] = {}
        first: dict[int, int] = {}
        for p, q in zip(group["p"], group["q"], strict=True):
            p, q = _find(local, _find(root, p)), _find(local, _find(root, q))
            if p != q:
                local[max(p, q)] = min(p, q)
        sets = defaultdict(set)
        for p, q, eid in zip(group["p"], group["q"], group["eid"], strict=True):
            top = _find(local, _find(root, p))
            sets[top] |= {_find(root, p), _find(root, q)}
            first[top] = min(eid, first.get(top, eid))
        for top, members in sets.items():
            total = sum(size[m] for m in members)
            big = sorted(m for m in members if m in held)
            small = [m for m in members if m not in held]
            away = [x for m in small for x in loose.pop(m)]
            now = None
            if len(big) == 1:
                cluster, acc = held.pop(big[0])
                now = cluster, acc + rate * sum(size[m] for m in small)
            elif len(big) > 1 or total >= least:
                now = 2 * int(first[top]) + 1, rate * total
                for m in big:
                    cluster, acc = held.pop(m)
                    out.append(("cluster", None, size[m], cluster, acc, now[0], rate))
            if now:
                held[top] = now
                out += [("exit", x, None, now[0], None, None, None) for x in away]
            else:
                loose[top] = away
            for m in members:
                root[m] = top
            size[top] = total
    top = _find(root, int(nodes["node"].iloc[0]))
    cluster, acc = held.get(top, (None, None))
    out.append(("node", top, size[top], cluster, acc, None, None))
    out += [("into", n, None, top, None, None, None) for n in nodes["node"]]
    return pd.DataFrame(out, columns=["kind", "node", "size", "cluster", "acc", "parent", "birth"])


def _choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(cluster, label): the chosen cluster that each one is in, if any. Clusters are at most twice the rows over the least weight."""
    all_ = pd.concat(list(parts) or [pd.DataFrame(columns=["cluster", "parent", "birth", "acc", "size"])])
    stable, below, chosen = {}, defaultdict(float), set()
    under = dict(zip(all_["cluster"], all_["parent"], strict=True))
    for c, parent, birth, acc, size in all_.sort_values("birth", ascending=False, na_position="last")[["cluster", "parent", "birth", "acc", "size"]].itertuples(index=False):
        if pd.isna(parent):
            continue  # the root is everything
        stable[c] = acc - size * birth
        if stable[c] >= below[c]:
            chosen.add(c)
        below[parent] += max(stable[c], below[c])
    out = []
    for c in under:
        label, at = None, c
        while at is not None and not pd.isna(at):
            label = at if at in chosen else label
            at = under.get(at)
        out.append((c, label))
    yield pd.DataFrame(out, columns=["cluster", "label"]).astype({"cluster": "int64", "label": "Int64"})


def condensed_labels(points: DataFrame, tree: DataFrame, least_size: int, floor: float = 1e-6, band: int = IN_ONE_TASK) -> DataFrame:
    """(id, label) of points in a chosen cluster, from the tree's edges (w, a, b). Distances below ``floor`` count as it.

    Edges are taken in bands of about ``band`` edges of neighbouring weights. What the bands below have joined is one node with its weight
    and its open cluster, and each component of a band is merged in a task of its own.
    """
    edges = checkpointed(tree.withColumn("eid", F.monotonically_increasing_id()))
    count = edges.count()
    cuts = sorted(set(edges.approxQuantile("w", [i * band / count for i in range(1, -(-count // band))], 0.25 * band / count))) if count > band else []
    own = F.col("n") >= least_size
    nodes = points.select(F.col("id").alias("node"), F.col("n").alias("size"), F.when(own, 2 * F.col("id")).alias("cluster"), F.when(own, F.col("n") / F.lit(floor)).alias("acc"))
    place = points.select("id", F.col("id").alias("node"))
    exits = points.filter(own).select("id", (2 * F.col("id")).alias("cluster"))
    ended = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        here = edges if low is None else edges.filter(F.col("w") > low)
        here = here if high is None else here.filter(F.col("w") <= high)
        here = here.join(place.select(F.col("id").alias("a"), F.col("node").alias("p")), "a").join(place.select(F.col("id").alias("b"), F.col("node").alias("q")), "b").select("w", "eid", "p", "q")
        here = checkpointed(here)
        if here.isEmpty():
            continue
        label = components(here.select(F.col("p").alias("a"), F.col("q").alias("b")))
        of_edges = here.join(label.select(F.col("node").alias("p"), F.col("label").alias("of")), "p")
        of_nodes = nodes.join(label.select("node", F.col("label").alias("of")), "node")
        done = of_edges.groupBy("of").cogroup(of_nodes.groupBy("of")).applyInPandas(lambda e, n: _merge(e, n, least_size, floor), NODE)
        done = checkpointed(done)
        still = nodes.join(label.select("node"), "node", "left_anti")
        nodes = checkpointed(done.filter("kind = 'node'").select("node", "size", "cluster", "acc").unionByName(still.select("node", "size", "cluster", "acc")))
        left = done.filter("kind = 'exit'").select("node", F.col("cluster").alias("into"))
        exits = checkpointed(exits.unionByName(place.join(left, "node").select("id", F.col("into").alias("cluster"))))
        into = done.filter("kind = 'into'").select("node", F.col("cluster").alias("to"))
        place = checkpointed(place.join(into, "node", "left").select("id", F.coalesce("to", "node").alias("node")))
        closed = done.filter("kind = 'cluster'").select("cluster", "parent", "birth", "acc", "size")
        ended = closed if ended is None else ended.unionByName(closed)
    roots = nodes.filter("cluster IS NOT NULL").select("cluster", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("birth"), "acc", "size")
    ended = roots if ended is None else ended.unionByName(roots)
    chosen = checkpointed(ended.coalesce(1).mapInPandas(_choose, "cluster long, label long"))
    # a point is loose in one band only: its first exit is its own
    return exits.dropDuplicates(["id"]).join(chosen.filter("label IS NOT NULL"), "cluster").select("id", "label")


def density_clusters(rows: DataFrame, features: list[str], least_size: int = 2000, samples: int = 100, width: float = 0.25, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """rows with `cluster`, numbered from 0 by falling row count, -1 for noise.

    Density is that of rows: equal vectors are one point with their count as weight, ``samples`` and ``least_size`` count rows. A row with a null
    feature is noise. ``width`` is the first cell width; it steers the work, not the result. Clusters are those of greatest stability
    below the root, so data in one piece is all noise.
    """
    vector = F.array(*[F.col(c).cast("double") for c in features])
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    placed = rows.withColumn("_v", F.when(whole, F.transform(vector, lambda x: x + 0.0)))
    points = placed.filter("_v IS NOT NULL").groupBy(F.col("_v").alias("v")).agg(F.count("*").alias("n"))
    points = checkpointed(points.withColumn("id", F.monotonically_increasing_id()))
    if points.limit(2).count() < 2:
        return placed.withColumn("cluster", F.lit(-1)).drop("_v")
    dims = min(GRID, len(features))
    cored = core_distances(points, samples, width, dims)
    tree = spanning_tree(cored, width, dims, in_one_task)
    labels = condensed_labels(points, tree, least_size, band=in_one_task)
    named = points.join(labels, "id").select("v", "n", "label")
    sized = named.groupBy("label").agg(F.sum("n").alias("rows"), F.min("v").alias("low"))
    numbered = sized.select("label", (F.row_number().over(Window.orderBy(F.desc("rows"), "low")) - 1).alias("cluster"))  # at most rows / least_size of them
    of = counted(named.join(numbered, "label").select(F.col("v").alias("_v"), "cluster"))
    return placed.join(of, "_v", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("int")).drop("_v")
