"""A corpus pipeline: five of the operators in a row, each stage written and read again.

A stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents; other columns of docs, whatever their names, are left out. Each row is judged by itself, whatever its doc_id: rows
that share one, or have none, stay or go apart. Every stage reads whole texts, takes nulls in any column, and gives no rows for an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transferlake.llm.common import checkpointed, table
from transferlake.llm.decontam import find_leaks
from transferlake.llm.langid import identify_languages
from transferlake.llm.packing import pack_documents
from transferlake.llm.queries import VOCABULARY, severity_model
from transferlake.llm.simhash import near_duplicates
from transferlake.llm.toxicity import drop_toxic
from transferlake.sources.files import new_folder, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row, written once so that the keys hold."""
    return checkpointed(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed whose row_key is not in gone. Those keys are few against the texts; they are written as a file, so that the planner knows their size and moves no text where they are small."""
    path = new_folder(keyed.sparkSession, "gone")
    gone.select("row_key").distinct().write.parquet(path)
    return keyed.join(keyed.sparkSession.read.parquet(path), "row_key", "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject.

    It is learned from docs alone. Null and empty texts, and those without a letter, go; a null lang, source, n_chars or doc_id is no reason to. Repeated
    rows all stay or all go; a text of any length is judged as a whole.
    """
    rows = docs.select("doc_id", "text", "lang", F.struct(*COLUMNS).alias("row"))  # goes through the operator with its verdict, so that no text is shuffled
    return identify_languages(rows, carried=("row",)).where("not rejected").select("row.*")


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on those of docs that have labels, does not reject.

    Without toxic and other labelled documents there is no model and all stay. Null and empty texts have no words and stay, unless most labelled documents
    are toxic. Repeated rows all stay or all go; rows with a null doc_id teach nothing and are judged.
    """
    return drop_toxic(docs.select(*COLUMNS), severity_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, one without an id only if there is no other.

    Null texts, empty ones and those of white space are one group. Of rows that are alike in id and text one stays.
    """
    keyed = _keyed(docs)
    groups = checkpointed(near_duplicates(keyed, id_column="row_key").select("row_key", "component_id").join(keyed.select("row_key", "doc_id"), "row_key"))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = groups.join(first.select("component_id", F.col("first.row_key").alias("stays")), "component_id").where("row_key <> stays")
    return _without(keyed, gone)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing and stay; repeated rows all stay or all go; an empty benchmark takes none.
    """
    keyed = _keyed(docs)
    return _without(keyed, find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_column="row_key"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 1024 tokens.

    Null and empty texts are one token each, long texts go on over many sequences, repeated rows are packed each and rows with a null doc_id too.
    """
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("toxicity", filter_toxicity),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]
#: SQL can express neither the models nor the tokenizer; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read as the next one's docs."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
