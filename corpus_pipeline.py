"""A training corpus from the documents table: language, lines, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm import decontam, langid, linededup, packing, simhash
from lexispan.llm.common import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; null texts and those without letters go, and those of too low a probability.

    Rows of null or repeated doc_id are documents of their own. Without a labelled row no language is known and all go.
    """
    return langid.identify(docs, langid.fitted(docs)).where("not rejected").select("row.*")


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are like an earlier one; n_chars follows the text. Documents that lose all their words go.

    A null text stays null, with an n_chars of null, and a text that had no words stays as it is. Of repeated rows the
    first keeps its lines; null ids come first.
    """
    found = linededup.dedup_lines(docs)
    found = found.where((F.col("n_removed") == 0) | linededup.has_words(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the first row by doc_id, null first; null texts count as empty and are alike."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null and empty texts hold none, null items have none."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("items") == 0).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens. Null texts count as empty and have the end token alone; each row is a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("lines", own_lines),
    ("near duplicates", one_of_each_group),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: The language and packing stages are not SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
