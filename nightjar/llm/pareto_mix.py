"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is shared among its documents in proportion to a weight, by default the number of binary
digits of a document's size, so that longer documents are somewhat likelier: a document's expected number of copies is
its weight times a level at which the expected words add up to the target, at most ``most``. Its whole part is given for
certain; the fraction left is the document's inclusion probability, and these are unequal within a source. Documents are ranked by
random odds u / (1 - u) over inclusion odds (Pareto order sampling), and the sample is the head of that ranking
whose size, measured in words, comes nearest to what is left of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.llm._common import broadcast_if_small, global_row_number, pinned

MOST_COPIES, MOST_WEIGHT, SEED, CELLS = 3, 1000, "nightjar-mix-1", 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words between ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> the same with target: the total shared by weight, at most ``most`` times the size.

    Weights repeat along the sources by code point, null last. Sources above their cap are held to it and the rest is
    shared anew, until none is above. Sources are numbered and summed by distributed steps, so there may be many.
    """
    numbered = global_row_number(sizes, [F.col("source").asc_nulls_last()], "_place")
    repeated = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = pinned(numbered.select("source", "source_size", repeated.cast("double").alias("w"), (F.col("source_size") * most).cast("double").alias("cap")))
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("w") * level if capped >= 0 else F.lit(False)
        n, held, shared = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if n == capped or not shared:
            break
        capped, level = n, (total - (held or 0.0)) / shared
    # if the last source reached its cap as well, all have theirs
    goal = F.when(F.col("cap") > F.col("w") * level, F.col("w") * level).otherwise(F.col("cap")) if shared else F.col("cap")
    return weighed.select("source", "source_size", goal.alias("target"))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and the keys."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def _levels(cells: DataFrame, most: int) -> DataFrame:
    """(source, source_size, target, weight, words) -> share, the expected copies of a document of that weight, whole and rest.

    A source has at most MOST_WEIGHT cells. From the heaviest weight down, cells are at ``most`` copies until the level that
    is left keeps a weight below it; that level holds from there. rest is what whole copies leave of the target.
    """
    down = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("weight") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("target") - most * before) / onward.cast("double")
    placed = cells.filter("words > 0").withColumn("level", level).withColumn("place", F.row_number().over(down))
    every = Window.partitionBy("source")
    first = F.min(F.when(F.col("weight") * F.col("level") < most, F.struct("place", "level"))).over(every)
    capped = F.coalesce(F.col("place") < first["place"], F.lit(True))
    shared = placed.withColumn("share", F.when(capped, F.lit(float(most))).otherwise(F.col("weight") * first["level"]))
    shared = shared.withColumn("whole", F.least(F.floor("share"), F.lit(most)).cast("int"))
    given = F.sum(F.col("whole") * F.col("words")).over(every)
    return shared.select("source", "source_size", "target", "weight", "whole", (F.col("share") - F.col("whole")).alias("part"), (F.col("target") - given).alias("rest"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, most: int = MOST_COPIES, weights: tuple[int, ...] = (1, 2, 3), weight: Column | None = None, cells: int = CELLS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, weight, copies, taken.

    taken = copies * size, copies is at most ``most``. weight is a document's whole number from 1 to MOST_WEIGHT (others, and
    null, are moved into this range); a document's chance is proportional to it. The ranking's cut is found on counts of ``cells`` cells of
    the ranks' range for each source; only the one cell that the cut falls into is ranked row by row, so a
    source of any share of the rows is dealt over many tasks. Random numbers hang on (id, size), so reruns agree
    at any partitioning; rows that repeat both are interchangeable. Wordless and null texts have size 0 and take
    nothing. A null source is a source of its own, last in order. Other columns are not read.
    """
    size = words(F.col(text_col))
    heavy = F.length(F.bin(size)) if weight is None else weight
    heavy = F.greatest(F.lit(1), F.least(F.coalesce(heavy.cast("int"), F.lit(1)), F.lit(MOST_WEIGHT)))
    sized = pinned(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), heavy.alias("weight")))
    cell = pinned(sized.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    goal = targets(cell.groupBy("source").agg(F.sum("words").alias("source_size")), most, weights)
    goal = goal.withColumnRenamed("source", "of")
    whole = pinned(goal.join(cell, F.col("of").eqNullSafe(F.col("source"))).drop("of"))
    plain = whole.filter("words = 0").select("source", "source_size", "target", "weight", F.lit(0).alias("whole"), F.lit(0.0).alias("part"), F.lit(0.0).alias("rest"))
    goal = pinned(_levels(whole, most).unionByName(plain)).withColumnsRenamed({"source": "of", "weight": "weighing"})
    rows = sized.join(broadcast_if_small(goal), F.col("source").eqNullSafe(F.col("of")) & (F.col("weight") == F.col("weighing"))).drop("of", "weighing")
    u = uniform(F.col("doc_id"), F.col("size"))
    inclusion = F.col("part") / (1 - F.col("part"))
    odds = F.when(inclusion > 0, u / (1 - u) / inclusion)
    # odds / (1 + odds) keeps the order and spreads the ranks over (0, 1)
    rows = rows.withColumn("q", odds / (1 + odds)).withColumn("cell", F.floor(F.col("q") * cells).cast("int"))
    drawn = F.col("q").isNotNull() & (F.col("size") > 0)
    counted = rows.filter(drawn).groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = counted.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cut = cut.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select(F.col("source").alias("of"), F.col("cell").alias("cut"), "before")
    cut = pinned(cut)  # at most one row a source
    rows = rows.join(broadcast_if_small(cut), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    inside = drawn & (F.col("cell") == F.col("cut"))
    in_cell = Window.partitionBy("source").orderBy("q", "doc_id", "size")
    edge = rows.filter(inside).withColumn("upto", F.col("before") + F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a row is in if the head that ends with it is nearer to the rest than the head before it
    edge = edge.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int"))
    others = rows.filter(~F.coalesce(inside, F.lit(False)))
    full = others.withColumn("more", (drawn & (F.col("cut").isNull() & (F.col("rest") > 0) | (F.col("cell") < F.col("cut")))).cast("int"))
    both = full.unionByName(edge.drop("upto"))
    copies = (F.col("whole") + F.coalesce("more", F.lit(0))).cast("int")
    return both.select("doc_id", "source", "size", "source_size", "target", "weight", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, all columns, as often as the mix takes them (rows without words: not at all).

    Rows that repeat (id, size, source) share the copies that the mix gives them all, as evenly as whole numbers allow.
    """

    def keys(frame: DataFrame, doc: str, source: str) -> list[Column]:
        """The pool of a row, without nulls, so that rows are dealt by it once for the join and for the numbering."""
        return [F.coalesce(F.col(doc).cast("long"), F.lit(0)).alias("_id"), F.col(doc).isNull().alias("_id_null"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.col(source).isNull().alias("_source_null")]

    names = ["_id", "_id_null", "_source", "_source_null", "_size"]
    copies = mix(docs, id_col, text_col, source_col, **options)
    pool = copies.select(*keys(copies, "doc_id", "source"), F.col("size").alias("_size"), "copies").groupBy(*names).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    taken = docs.select("*", *keys(docs, id_col, source_col), words(F.col(text_col)).alias("_size")).join(pool.filter("_copies > 0 AND _size > 0"), names)
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(text_col)))
    each = (F.floor(F.col("_copies") / F.col("_rows")) + F.when(nth <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)).cast("int")
    counted = taken.withColumn("_each", each).filter("_each > 0")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select(*[F.col(f"`{c}`") for c in docs.columns])
