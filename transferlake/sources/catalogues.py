"""Catalogue text as lines: a document for each order, a course for each of its lines; and lists of general-education courses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .agreements import cells
from .stand_ins import read


def catalogue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): marked areas, course headers, labelled fields that may go on in a next line, descriptions and schedules."""
    c = cells(spark, sf_dir)
    size, pos, n = F.col("size"), F.col("pos"), F.col("number")
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    say = lambda x: x.cast("string")
    course = F.concat("prefix", F.lit(" "), n)
    lines = F.array(
        F.when((pos == 1) | (pos == 5), text("===== Area ", say(F.floor(pos / 4)), " =====")),
        F.when((pos == 1) | (pos == 5), text("~ under ", F.col("prefix"), ".")),
        text(course, ", ", F.col("title"), " ", say(size % 5 + 1), " UNITS"),
        F.when(size % 2 == 0, F.lit("Transfer: UC, CSU")),
        F.when(size % 3 == 0, text("C-ID: ", course, "00.")),
        F.when(size % 5 == 0, text("Cal-GETC Area ", say(size % 7 + 1))),
        F.when(size % 4 == 0, text("• Prerequisite: ", F.col("prefix"), " 1,")),
        F.when(size % 4 == 0, F.lit("and consent of instructor.")),
        F.when(size % 6 == 0, text("• Advisory: ", F.col("prefix"), " 2.")),
        F.when(size % 7 == 0, text("Formerly ", course, "A.")),
        text("Covers ", F.col("title"), " in part ", say(F.col("part")), "."),
        F.when(pos % 2 == 0, text(say(1 + F.col("supp") % 9), ":00a.m.-", say(1 + F.col("supp") % 9), ":50p.m. ", F.element_at(F.array(*map(F.lit, ("MW", "TTh", "MWF"))), F.col("supp").cast("int") % 3 + 1), " BUS ", say(100 + pos), " Smith J")).otherwise(text("Arrange-", say(pos), " Hours N ", F.when(F.col("supp") % 2 == 0, "Staff").otherwise("ONLINE Jones Ann"))),
    )
    # Outer: no filter makes the lines again to see whether there are any; each row has its own header.
    rows = c.select(F.col("agreement").alias("doc_id"), "pos", F.posexplode_outer(F.array_compact(lines)).alias("k", "line"))
    return rows.select("doc_id", (F.col("pos") * 100 + F.col("k")).cast("int").alias("line_no"), "line")


def education_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line): tab-parted courses with areas and terms, rows that go on with further areas, and notes."""
    key, size = F.col("p_partkey"), F.col("p_size")
    tab = lambda *parts: F.concat_ws("\t", *(p if not isinstance(p, str) else F.lit(p) for p in parts))
    code = F.concat(F.col("p_type"), F.lit(" "), F.regexp_extract("p_brand", r"(\d+)", 1))
    year = (2000 + size % 20).cast("string")
    lines = F.array(
        F.when(key % 100 == 0, tab("COURSE", "TITLE", "UNITS", "AREAS", "APPROVED", "REMOVED")),
        tab(code, F.col("p_name"), F.concat((size % 5 + 1).cast("string"), F.lit(" units")), F.when(size % 2 == 0, "3A 4").otherwise("5B x"), F.concat(F.lit("F"), year), F.when(size % 3 == 0, F.concat(F.lit("Su"), year)).otherwise("")),
        F.when(size % 4 == 0, tab("", "", "", "4B", F.concat(F.lit("S"), year))),
        F.when(size % 5 == 0, F.concat(F.lit("Same as: "), F.col("p_type"), F.lit(" 9"))),
    )
    rows = read(spark, sf_dir, "part").select(F.floor(key / 100).alias("doc_id"), key.alias("key"), F.posexplode_outer(F.array_compact(lines)).alias("k", "line"))
    return rows.select("doc_id", (F.col("key") % 100 * 10 + F.col("k")).cast("int").alias("line_no"), "line")
