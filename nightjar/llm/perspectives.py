"""Chat formatting: multi-party perspective rotation.

Every participant of a dialogue gets a rendering of it in which their own turns are the assistant's, the others'
turns are those of named users, and only their own turns are in the training mask. System turns are a preamble in
every rendering and nobody's perspective. A rendering is kept as its segments, one row a turn, with their places in
the rendered text, so that no dialogue has to fit into one row or task; `joined` puts dialogues of known size
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from nightjar.llm._common import broadcast_if_small, partitions, pinned

START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
PREAMBLE, NAMELESS = "system", "unknown"


def _clean(text: Column) -> Column:
    """Markers inside a turn are broken up, so that a turn can't end itself."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_", "<| im_")


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, place, turn, speaker, shown_as, segment, start, mask_start, mask_end.

    start counts code points from the rendering's begin; [mask_start, mask_end) is what is trained on, null for
    context. Turns are in (turn, speaker, text) order, which settles ties; repeated turns are all rendered. A null
    role is the speaker "unknown", a null text is empty, null turns come first, and rows of a null conv_id are one
    dialogue. A dialogue with only system turns has no participant and gives no rows. Other columns are not read.
    """
    speaker = F.coalesce(F.regexp_replace(F.col(role_col), r"[\s<>|]+", "_"), F.lit(NAMELESS))
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), _clean(F.col(text_col)).alias("text"))
    people = said.filter(F.col("speaker") != PREAMBLE).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    each = said.join(people, said["conv_id"].eqNullSafe(people["of"])).drop("of")
    own = F.col("speaker") == F.col("perspective")
    shown = F.when(F.col("speaker") == PREAMBLE, PREAMBLE).when(own, "assistant").otherwise(F.concat(F.lit("user name="), "speaker"))
    each = each.withColumn("shown_as", shown).withColumn("head", F.concat(F.lit(START), "shown_as", F.lit(BREAK)))
    each = each.select("conv_id", "perspective", "turn", "speaker", "shown_as", F.concat("head", "text", F.lit(END + BREAK)).alias("segment"), own.alias("own"), F.length("head").cast("long").alias("head"))
    each = each.withColumn("size", F.length("segment").cast("long"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "perspective", "turn", "speaker", "segment")]
    dealt = pinned(each).repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    kind = T.StructType(dealt.schema.fields + [T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at, place = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            starts, places = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i, (conv, who, size) in enumerate(zip(batch["conv_id"].to_pylist(), batch["perspective"].to_pylist(), batch["size"].to_pylist(), strict=True)):
                if (conv, who) != last:
                    last, at, place = (conv, who), 0, 0
                starts[i], places[i] = at, place
                at, place = at + size, place + 1
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(starts), pa.array(places)]
            yield pa.RecordBatch.from_arrays(batch.columns + more, names=batch.schema.names + ["part", "start", "place"])

    placed = pinned(dealt.mapInArrow(run, kind))
    # a rendering may go on over several partitions: what lies before is added, at most one row a partition
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("conv_id", "perspective", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    carried = carried.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("k"), F.sum("size").over(before).alias("ahead"), F.sum("n").over(before).alias("turns")).filter("turns > 0")
    carried = broadcast_if_small(pinned(carried))
    same = placed["conv_id"].eqNullSafe(F.col("c")) & (placed["perspective"] == F.col("p")) & (placed["part"] == F.col("k"))
    whole = placed.join(carried, same, "left").withColumn("start", F.col("start") + F.coalesce("ahead", F.lit(0))).withColumn("place", F.col("place") + F.coalesce("turns", F.lit(0)))
    return whole.select(
        "conv_id", "perspective", "place", "turn", "speaker", "shown_as", "segment", "start",
        F.when(F.col("own"), F.col("start") + F.col("head")).alias("mask_start"),
        F.when(F.col("own"), F.col("start") + F.col("size") - F.lit(len(BREAK))).alias("mask_end"),
    )


def joined(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, rendering, mask: one row a rendering, for dialogues that are known to fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("place", "segment", "mask_start", "mask_end")))
    whole = segments.groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: F.struct(p["mask_start"].alias("begin"), p["mask_end"].alias("end"))), lambda s: s["begin"].isNotNull())
    return whole.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("rendering"), spans.alias("mask"))
