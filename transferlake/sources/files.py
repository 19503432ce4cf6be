"""Files of records: JSON lines with an optional header, one folder per group, labelled CSV."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a temporary one is set, but only if driver and executors are one process; on a cluster that is an error,
    since executors could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder: lineage ends there, and lost executors cost no more than what follows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON-lines files; header lines with a ``_metadata`` key, blank lines and malformed ones are left out."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).where((F.trim("value") != "") & F.get_json_object("value", "$._metadata").isNull())
    return lines.select(parsed.alias("r")).where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line; null fields are left out of it."""
    rows.write.option("ignoreNullFields", True).json(path)


def write_groups(rows: DataFrame, path: str, group: str) -> None:
    """One folder per group; a group of any size is written by as many tasks as hold its rows."""
    rows.write.partitionBy(group).parquet(path)


def read_labelled(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of CSV files with a header, exact repeats once. A file without a required column is an error."""
    found = spark.read.option("header", True).csv(path).columns
    if lacking := [c for c in required if c not in found]:
        raise ValueError(f"columns missing: {', '.join(lacking)}")
    return spark.read.option("header", True).schema(schema).csv(path).dropDuplicates()


def read_json_tree(spark: SparkSession, path: str, schema: str, name_column: str, skip: tuple[str, ...] = ("extra_refs",)) -> DataFrame:
    """One record a file of all JSON files below a folder; unreadable files, and those whose name has one of ``skip`` in it, are left out.

    A record without a name takes that of its file, without the ending.
    """
    held = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    named = held.withColumn("file_name", F.col("_metadata.file_name"))
    kept = named.where(F.col("_corrupt_record").isNull())
    for part in skip:
        kept = kept.where(~F.contains("file_name", F.lit(part)))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    return kept.withColumn(name_column, F.coalesce(F.nullif(F.trim(name_column), F.lit("")), stem)).drop("_corrupt_record", "file_name")
