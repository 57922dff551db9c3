"""The llm operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import oracles
from orrery.session import shipped


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The columns of all documents, with work for all cores."""
    from orrery.llm.parts import spread

    docs = _table(spark, sf_dir, "documents")
    return spread(docs.select(*columns) if columns else docs)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.quality_rules import quality_rules

    judged = quality_rules(_documents(spark, sf_dir, "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import chat

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.sql(r"SELECT -7L, turn, role, r'\### Assistant: </turn> ok' FROM VALUES (0, 'user'), (1, 'assistant') AS probe (turn, role)"))
    back = chat.parse(chat.format_chats(chat.rows_as_events(rows)))
    said = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.substring_dedup import substring_dedup

    return substring_dedup(_documents(spark, sf_dir, "doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.packing import best_fit_packing

    return best_fit_packing(_documents(spark, sf_dir, "doc_id", "text"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.near_dedup import near_dedup

    return near_dedup(_documents(spark, sf_dir, "doc_id", "text"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.mixing import mix_sources

    lines, mix = mix_sources(_documents(spark, sf_dir, "doc_id", "text", "source"))
    taken = mix.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    lines = lines.withColumn("_at", F.when(F.col("size") > 0, F.col("start")))  # only rows with words have a place of their own
    lines = lines.join(taken.withColumnRenamed("start", "_at"), ["source_no", "_at"], "left")
    return lines.select(F.col("key").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.language_id import language_id

    docs = _documents(spark, sf_dir, "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    found = language_id(docs, docs.where(fold != 1))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source; the language stands for the path below it."""
    from orrery.llm.quality_classifier import quality_classifier

    judged = quality_classifier(_documents(spark, sf_dir, "doc_id", "text", "source", "lang"), _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return judged.select("doc_id", "quality", "toxicity", "quality_posterior", "toxicity_posterior", "kept")


def op9_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the whole texts of all documents whose id is divisible by 50."""
    from orrery.llm.search import top_k

    docs = _documents(spark, sf_dir, "doc_id", "text")
    return top_k(docs, docs.where(F.col("doc_id") % 50 == 0)).withColumnRenamed("query", "query_id")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.lm_scoring import lm_scores

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return lm_scores(_documents(spark, sf_dir, "doc_id", "text"), held_out)


QUERIES = (
    op1_substring_dedup, op2_mix_sources, op3_best_fit_packing, op4_quality_rules, op5_chat_format, op6_near_dedup,
    op7_quality_classifier, op8_lm_scores, op9_bm25_top_k, op10_language_id,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
