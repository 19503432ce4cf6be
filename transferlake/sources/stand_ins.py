"""Domain tables as fixed projections of the benchmark tables, so that every query grows with its input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Letter grades by hundredths of discount: fixed values.
LETTERS = ["A+", "A-", "B+", "B", "B-", "C+", "C", "C-", "D", "F", "P"]
REQUIREMENTS, OPTIONS, SLOTS, CODES = 60, 3, 2, 150
#: Lines that are joined, sorted or grouped in one task.
TASK_ROWS = 100_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, lines: int, *keys: str) -> DataFrame:
    """rows by their keys, in tasks of about ``TASK_ROWS`` of so many lines where the session's number of partitions would make larger ones."""
    tasks = math.ceil(lines / TASK_ROWS)
    more = tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys) if more else rows.repartition(*keys)


def _code():
    return F.concat_ws(" ", "p_type", F.regexp_extract("p_brand", r"(\d+)", 1))


def courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, title, units, number): one row per type and brand of part."""
    part = read(spark, sf_dir, "part").select(_code().alias("code"), "p_name", "p_size")
    rows = part.groupBy("code").agg(F.min("p_name").alias("title"), (1 + F.min("p_size") % 5).cast("int").alias("units"))
    return rows.withColumn("number", F.regexp_extract("code", r"(\d+)$", 1).cast("int"))


def student_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student, code, grade): a repeated course keeps its earliest line. Rows are dealt by student, so that what is asked of a student's courses is found where they are."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("student"))
    part = read(spark, sf_dir, "part").select("p_partkey", _code().alias("code"))
    n = lines.count()  # from the files' footers
    if n > TASK_ROWS * int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines, orders, part = dealt(lines, n, "l_orderkey"), dealt(orders, n, "o_orderkey"), dealt(part, n, "p_partkey")
        owned = dealt(lines.join(orders, lines.l_orderkey == orders.o_orderkey), n, "l_partkey")
    else:
        owned = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    taken = dealt(owned.join(part, owned.l_partkey == part.p_partkey).select("student", "code", "l_orderkey", "l_linenumber", "l_discount"), n, "student")
    first = taken.groupBy("student", "code").agg(F.min_by("l_discount", F.struct("l_orderkey", "l_linenumber", "l_discount")).alias("d"))
    return first.select("student", "code", F.element_at(F.array(*map(F.lit, LETTERS)), F.round(F.col("d") * 100).cast("int") + 1).alias("grade"))


def order_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student, code): the courses of each order, a student's plan for one term."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("student"), "l_partkey")
    part = read(spark, sf_dir, "part").select("p_partkey", _code().alias("code"))
    return lines.join(part, lines.l_partkey == part.p_partkey).select("student", "code").distinct()


def option_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(requirement, option, slot, code): each requirement has three options of two courses."""
    place = F.row_number().over(Window.orderBy("code")) - 1  # at most CODES rows
    codes = courses(spark, sf_dir).select("code").withColumn("at", place)
    slots = spark.range(REQUIREMENTS).select(F.col("id").cast("int").alias("requirement")).withColumn("option", F.explode(F.sequence(F.lit(0), F.lit(OPTIONS - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    slots = slots.withColumn("at", (F.col("requirement") * 7 + F.col("option") * 31 + F.col("slot") * 53) % CODES)
    return slots.join(codes, "at").select("requirement", "option", "slot", "code")


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, section, day, begins, ends) in minutes of the day."""
    begins = F.hour("ts") * 60 + F.minute("ts")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("section"), (F.col("event_id") % 7).cast("int").alias("day"), begins.alias("begins"), (begins + 30 + F.col("event_id") % 90).cast("int").alias("ends"))


def prerequisite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(course, needs): part key to its half and its third."""
    key = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(key.alias("course"), F.explode(F.array_distinct(F.array(F.floor(key / 2), F.floor(key / 3)))).alias("needs"))
    return part.where("needs >= 1 and needs < course")


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, starts, ends, priority)."""
    begins = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event"), begins.alias("starts"), F.date_add(begins, (F.col("o_orderkey") % 30).cast("int")).alias("ends"), F.col("o_orderpriority").alias("priority"))
