"""Corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.llm.common import table, work_folder
from runloom.llm.crf_langid import keep_identified
from runloom.llm.decontaminate import drop_contaminated
from runloom.llm.line_runs import dedup_lines
from runloom.llm.mixing import mix
from runloom.llm.near_join import one_per_class


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_identified(docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut; a document of nothing else goes."""
    out = dedup_lines(docs)
    return out.where("NOT (n_deleted > 0 AND trim(regexp_replace(text, '\\\\s+', ' ')) = '')").select(docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_per_class(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with posteriors and rates that meet the target weights.

    Rows without doc_id stay and share one row of weights, as rows that repeat a doc_id do.
    """
    soft = mix(docs, table(spark, sf_dir, "labels"))
    names = [c for c in soft.columns if c != "doc_id"]
    soft = soft.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "_soft_id")
    docs = docs.drop(*names)
    return docs.join(soft, docs["doc_id"].eqNullSafe(soft["_soft_id"]), "left").drop("_soft_id")


STAGES = [
    ("language_id", identify_language), ("line_dedup", cut_repeated_lines), ("near_duplicates", one_of_near_duplicates),
    ("decontamination", remove_benchmark), ("mixing", weigh),
]
#: The language model, the MinHash candidates and the rates cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
