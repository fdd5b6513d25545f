"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm import bin_slack, byte_bpe, cotrain, cuckoo, dialogue_repair, feistel_shards, license_scan, line_dedup, order_minhash, pareto_mix, periodic_runs, perspectives, simhash_index
from nightjar.llm._common import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op2_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_index.near_duplicates(table(spark, sf_dir, "documents"))


def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), digest.alias("text_sha256"))


def op4_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "kept")


def op5_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_groups(table(spark, sf_dir, "documents"))


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = pareto_mix.mix(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "weight", "copies")


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.shards(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))).withColumn("best", periodic_runs.strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_order_minhash,
        op2_simhash_gray_index,
        op3_fuzzy_line_dedup,
        op4_cotrained_quality,
        op5_bin_slack_packing,
        op6_license_scan,
        op7_cuckoo_exact_dedup,
        op8_pareto_mix,
        op9_perspective_rotation,
        op10_feistel_shards,
        op11_periodic_runs,
        op12_byte_bpe,
        op13_dialogue_repair,
    )
}
