"""Files chosen before they are read: an inventory table (one row a file) is pruned, then only the chosen paths are opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Suffixes of compressed files, the rank from which dates count down, and the reasons why a pattern is read whole.
COMPRESSED, DATE_RANK = r"\.(gz|bz2|xz)$", 99_999_999
DUPLICATE, OVERLAP, DISORDER = "duplicate rotation files", "overlapping export windows", "rotation order not monotonic"
# An export's name: base_YYYYMMDD_Nd or base_YYYYMMDD_to_YYYYMMDD_HHh, then any suffix.
EXPORT = r"^(.+?)_(\d{8})_(?:(\d+)d|to_(\d{8})_(\d{2})h)(\..*)?$"


def list_files(spark: SparkSession, paths: list[str] | str, glob: str | None = None) -> DataFrame:
    """(file, size) of all files under the paths; contents aren't read. A file reached twice is listed once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths).select(F.col("path").alias("file"), F.col("length").alias("size")).distinct()


def first_times(lines: DataFrame, at: Column) -> DataFrame:
    """(file, first_ts): the time of each file's first line that isn't blank or a comment; null if that line has none.

    lines: file, value and `line`, a number that grows through the file. It is computed when a file is taken into the inventory, not per query.
    """
    said = lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))
    return said.groupBy("file").agg(F.min(F.struct("line", at.alias("ts"))).alias("m")).select("file", F.col("m.ts").alias("first_ts"))


def grown(held: DataFrame, listed: DataFrame) -> DataFrame:
    """Files of a listing that the inventory doesn't hold at that size: those whose first times are still to be read."""
    return listed.join(held.select("file", "size"), ["file", "size"], "left_anti")


def named(inventory: DataFrame) -> DataFrame:
    """The inventory with folder, name, dated (date of the nearest dated folder, else null)."""
    bare = F.regexp_replace("file", r"/+$", "")
    day = F.regexp_extract(bare, r"^.*/(\d{4}-\d{2}-\d{2})[^/]*/[^/]*$", 1)
    return inventory.withColumns({"folder": F.regexp_extract(bare, r"^(.*)/[^/]*$", 1), "name": F.regexp_extract(bare, r"([^/]*)$", 1), "dated": F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")})


def primary(files: DataFrame, kind: str) -> DataFrame:
    """Files whose name up to its first dot is the log's kind: conn.log and conn.10:00.log.gz, not conn-summary.log."""
    return files.filter(F.substring_index("name", ".", 1) == kind)


def in_folders(files: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    """Files outside dated folders, and those of folders whose UTC day touches the window."""
    starts = F.unix_date("dated").cast("long") * 86400
    fits = F.lit(True)
    if since is not None:
        fits = fits & (starts + 86400 > since)
    if until is not None:
        fits = fits & (starts <= until)
    return files.filter(F.col("dated").isNull() | fits)


def rotations(files: DataFrame) -> DataFrame:
    """files with stem (name without compression), base, rank (0 is newest, then ever older), opens and closes (an export's declared window).

    name.N ranks by N, name.YYYYMMDD and exports by date; an eight-digit number that is no date is an ordinal, and an export whose dates
    don't hold or whose window is empty is a file of its own.
    """
    stem = F.regexp_replace("name", COMPRESSED, "")
    tail = F.regexp_extract(stem, r"\.(\d+)$", 1)
    as_date = lambda text: F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")
    part = lambda i: F.nullif(F.regexp_extract(stem, EXPORT, i), F.lit(""))
    seconds = lambda day: F.unix_date(day).cast("long") * 86400
    opens = seconds(as_date(part(2)))
    days = F.when(F.length(part(3)) <= 6, part(3).try_cast("long"))
    closes = F.coalesce(opens + days * 86400, seconds(as_date(part(4))) + (part(5).try_cast("long") + 1) * 3600)
    numbered, export = tail != "", (tail == "") & (closes > opens)
    dated = numbered & (F.length(tail) == 8) & as_date(tail).isNotNull()
    base = F.when(numbered, F.regexp_replace(stem, r"\.\d+$", "")).when(export, part(1)).otherwise(stem)
    rank = F.when(dated, DATE_RANK - tail.try_cast("decimal(38,0)")).when(numbered, tail.try_cast("decimal(38,0)")).when(export, DATE_RANK - part(2).try_cast("decimal(38,0)")).otherwise(F.lit(0))
    return files.withColumns({"stem": stem, "base": base, "rank": F.coalesce(rank.cast("decimal(38,0)"), F.lit(0)), "opens": F.when(export, opens), "closes": F.when(export, closes)})


def choose(files: DataFrame, since: float | None = None, until: float | None = None, pattern: str = "pattern") -> DataFrame:
    """files (file, folder, name, first_ts and `pattern`) with chosen and reason (why a pattern is read whole, else null).

    In a group (pattern, folder, base) files go from newest to oldest. One that begins after the window goes; the first that begins before it may
    reach into it and stays, those older than it go. A file without a time always stays, unless it is older than that. If a group of a
    pattern can't be ordered (two files of one stem, export windows that overlap or stand beside files without one, a first time that
    rises towards older files before the search ends), all files of the pattern stay. The choice never decides which rows count: their own times do.
    """
    group = Window.partitionBy(pattern, "folder", "base")
    order = group.orderBy("rank", "name")
    older = order.rowsBetween(Window.unboundedPreceding, -1)
    by_start = group.orderBy("opens", "closes").rowsBetween(Window.unboundedPreceding, -1)
    marked = rotations(files).withColumns({
        "_same": F.count("*").over(Window.partitionBy(pattern, "folder", "base", "stem")), "_n": F.count("*").over(group), "_w": F.count("opens").over(group),
        "_meets": F.coalesce(F.col("opens") < F.max("closes").over(by_start), F.lit(False)), "_newer": F.last("first_ts", ignorenulls=True).over(older),
        "_past": F.coalesce(F.max((F.col("first_ts") < since) & ~(F.col("first_ts") > until if until is not None else F.lit(False))).over(older), F.lit(False)) if since is not None else F.lit(False),
    })
    exports = (F.col("_w") > 0) & (F.col("_n") > 1) & ((F.col("_w") < F.col("_n")) | F.col("_meets"))
    fault = F.when((F.col("_w") == 0) & (F.col("_same") > 1), DUPLICATE).when(exports, OVERLAP).when(~F.col("_past") & (F.col("first_ts") > F.col("_newer")), DISORDER)
    told = marked.withColumn("_fault", fault)
    # told of a pattern: its first group with a fault, and there a conflict of names before one of times
    worst = F.min(F.struct("folder", "base", (F.col("_fault") == DISORDER).alias("late"), F.col("_fault").alias("reason")))
    whole = told.filter("_fault IS NOT NULL").groupBy(F.col(pattern).alias("_of")).agg(worst.alias("_w")).select("_of", F.col("_w.reason").alias("reason"))
    after = F.coalesce(F.col("first_ts") > until, F.lit(False)) if until is not None else F.lit(False)
    told = told.withColumn("_kept", ~F.col("_past") & ~after).drop("_same", "_n", "_w", "_meets", "_newer", "_past", "_fault")
    told = told.join(whole, F.col(pattern).eqNullSafe(F.col("_of")), "left").drop("_of")
    return told.withColumn("chosen", F.col("reason").isNotNull() | F.col("_kept")).drop("_kept")


def read_chosen(spark: SparkSession, chosen: DataFrame, most: int = 200_000) -> DataFrame:
    """(file, value) of the chosen files alone. Their paths pass the driver, as for any reader; more than `most` are an error: narrow the window."""
    paths = [r.file for r in chosen.filter("chosen").select("file").distinct().limit(most + 1).collect()]
    if len(paths) > most:
        raise ValueError(f"more than {most} files touch the window")
    if not paths:
        return spark.createDataFrame([], "file string, value string")
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
