"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingscope import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark, sf_dir):
    from filingscope.llm.decontamination import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_warc(spark, sf_dir):
    from filingscope.llm.warc import archive_pages

    return archive_pages(_read(spark, sf_dir, "pages")).drop("record_id")


def op3_fertility(spark, sf_dir):
    from filingscope.llm.fertility import fertility_rules

    return fertility_rules(_read(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    from filingscope.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from filingscope.llm.line_dedup import dedupe_lines

    left = dedupe_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_deleted", "run_starts", "run_lines", F.octet_length("text").cast("long").alias("left_bytes"), F.crc32("text").alias("left_crc32"))


def op6_katz(spark, sf_dir):
    from filingscope.llm.katz import katz_scores

    return katz_scores(_read(spark, sf_dir, "documents"))


def op7_token_counts(spark, sf_dir):
    from filingscope.llm.token_counts import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    from filingscope.llm.sharding import assign_shards

    return assign_shards(_read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    from filingscope.llm.jaccard_join import join_sets

    return join_sets(_read(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    from filingscope.llm.quality_classifier import classify_quality

    return classify_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from filingscope.llm.substring_dedup import dedupe_substrings

    left = dedupe_substrings(_read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("left_text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark, sf_dir):
    from filingscope.llm.conversation_repair import repair_damaged

    return repair_damaged(_read(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark, sf_dir):
    from filingscope.llm.hard_negatives import mine_negatives

    return mine_negatives(_relabelled(_read(spark, sf_dir, "embeddings")))


def _relabelled(rows: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc, op3_fertility, op4_packing, op5_line_dedup, op6_katz, op7_token_counts, op8_sharding, op9_jaccard_join, op10_quality, op11_substring_dedup, op12_conversation_repair, op13_hard_negatives)}
