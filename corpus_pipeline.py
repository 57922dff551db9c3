"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

All stages take null in any column, empty and long texts (read whole), repeated rows and ids, and columns beside those of
``documents``, which are dropped; an empty table goes through as one. Null and empty texts fail the quality rules. Of
equal rows near_dedup keeps one. What the rules, the classes and the mix decide on ties is in their operators' docstrings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from orrery.llm.mixing import mix_sources, render
from orrery.llm.near_dedup import near_dedup
from orrery.llm.packing import best_fit_packing
from orrery.llm.parts import row_name, shared_folder
from orrery.llm.quality_rules import passing
from orrery.llm.substring_dedup import substring_dedup
from orrery.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every threshold."""
    ship(spark)
    return passing(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies: of rows with one id, the one that is least by hash.
    Rows without an id stay, one of equal ones."""
    ship(spark)
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(*COLUMNS, *row_name(*COLUMNS))
    least = rows.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("_a"))).agg(F.min(F.struct("_a", "_b")).alias("_row"))
    least = least.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("_row.*")
    nth = F.row_number().over(W.partitionBy("_a", "_b").orderBy("doc_id"))
    return rows.join(least, ["_a", "_b"], "left_semi").withColumn("_nth", nth).where("_nth = 1").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus; those with nothing left go."""
    ship(spark)
    cut = substring_dedup(docs, carry=("lang", "source"), with_text=True).where("n_words > n_removed")
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, one row a pass, so an id may repeat; a document that it takes nothing of goes."""
    ship(spark)
    mixed = render(docs.select(*COLUMNS), mix_sources(docs)[1])
    return mixed.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 1024, one row a piece."""
    ship(spark)
    return best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("mix_sources", mixture),
    ("best_fit_packing", packed),
]
#: Near-duplicate components, suffix trees, draws and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between them is in the cluster's shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
