"""Lines of documents in order: owners, merged lines and confirmed headers. Every window is within one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def fill_owner(lines: DataFrame, is_header: Column) -> DataFrame:
    """Each line with the last header at or above it; null above the first."""
    return lines.withColumn("owner", F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))


def merge_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, first_line, n, text): a line that starts in lower case joins the one before, unless that ends with ``.`` or ``:``."""
    joins = F.col("line").rlike("^[a-z]") & ~F.lag("line").over(in_order()).rlike(r"[.:]$")
    runs = lines.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("new").over(in_order()))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["line"]), " ").alias("text")).drop("run")


def confirmed_headers(lines: DataFrame, is_header: Column, confirms: Column, within: int = 5) -> DataFrame:
    """Headers that are confirmed on their line or one of the next ``within``."""
    seen = F.bool_or(confirms).over(in_order().rowsBetween(0, within))
    return lines.withColumn("is_header", is_header).withColumn("seen", seen).where("is_header and seen").select("doc_id", "line_no")


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")
