"""From raw documents to packed training sequences: the stages of the training-data pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerspark.llm.common import remainder, saved, table
from careerspark.llm.jaccard import near_duplicates
from careerspark.llm.language import identify
from careerspark.llm.packing import pack
from careerspark.llm.quality import classify

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SCORE = 0.3      # below it, a text is like no language that was learnt


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts without letters, and those far from every profile, go."""
    judged = identify(docs, learn=remainder("doc_id", 5) != 0, keep=list(COLUMNS))
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label model calls good."""
    return classify(docs, keep=list(COLUMNS)).filter("quality = 1").select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without an id are grouped among
    themselves, so a group that has both kinds keeps one of each. Texts without words are no group: of those with the same
    id and text one stays, those without an id are kept as they are."""
    rows = saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "deduplicated-rows")
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), threshold=0.75, width=5)
    found = found.select(F.col("doc_id").alias("_of"), F.col("component_id").alias("_class"), (F.col("n_shingles") > 0).alias("_words"))
    classed = rows.select("_row", "doc_id", F.md5("text").alias("_text")).join(found, F.col("_row") == F.col("_of"))
    first = F.min_by("_row", F.struct("doc_id", "_row"))
    linked = classed.filter("_words").groupBy("_class", F.col("doc_id").isNull()).agg(first.alias("_kept"))
    empty = classed.filter("not _words and doc_id is not null").groupBy("doc_id", "_text").agg(F.min("_row").alias("_kept"))
    others = classed.filter("not _words and doc_id is null").select(F.col("_row").alias("_kept"))
    kept = linked.select("_kept").unionByName(empty.select("_kept")).unionByName(others)
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in training sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("quality", quality), ("deduplicated", deduplicated), ("packed", packed)]

ORACLE_SQL = None   # SQL can't express the language, quality and packing stages; tests hold them against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
