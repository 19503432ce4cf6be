"""Units, grade points, breadth coverage and general-education roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Grade points, with and without plus and minus: fixed values. Other grades do not count.
POINTS = {"A+": 4.0, "A": 4.0, "A-": 3.7, "B+": 3.3, "B": 3.0, "B-": 2.7, "C+": 2.3, "C": 2.0, "C-": 1.7, "D+": 1.3, "D": 1.0, "D-": 0.7, "F": 0.0}
SIMPLE_POINTS = {"A": 4.0, "B": 3.0, "C": 2.0, "D": 1.0, "F": 0.0}


def grade_table(spark: SparkSession, simple: bool = False) -> DataFrame:
    """(grade, points); on the simple scale a plus or minus changes nothing."""
    points = {grade: SIMPLE_POINTS[grade[0]] if simple else value for grade, value in POINTS.items()}
    return spark.createDataFrame(list(points.items()), "grade string, points double")


def unit_totals(taken: DataFrame, courses: DataFrame) -> DataFrame:
    """(student, units, courses, unresolved): a course not in the catalog is counted as unresolved and has no units."""
    rows = taken.join(courses.select("code", "units"), "code", "left")
    return rows.groupBy("student").agg(F.coalesce(F.sum("units"), F.lit(0)).cast("long").alias("units"), F.count("units").alias("courses"), F.count_if(F.col("units").isNull()).alias("unresolved"))


def projected_gpa(taken: DataFrame, courses: DataFrame, prior: DataFrame, simple: bool = False) -> DataFrame:
    """(student, graded_units, gpa): prior points and graded courses together, cut off at two decimals.

    prior(student, gpa, units). Grades without points and courses of zero units are left out; a student without
    any graded units keeps the prior gpa.
    """
    graded = taken.join(F.broadcast(grade_table(taken.sparkSession, simple)), "grade").join(courses.select("code", "units"), "code").where("units > 0")
    sums = graded.groupBy("student").agg(F.sum(F.col("points") * F.col("units")).alias("p"), F.sum("units").alias("u"))
    rows = prior.join(sums, "student", "left")
    total = F.col("units") + F.coalesce("u", F.lit(0))
    mean = (F.col("gpa") * F.col("units") + F.coalesce("p", F.lit(0.0))) / total
    cut = F.floor(F.round(mean, 6) * 100 + F.lit(1e-9)) / 100
    return rows.select("student", F.coalesce("u", F.lit(0)).cast("long").alias("graded_units"), F.when(F.coalesce("u", F.lit(0)) > 0, cut).otherwise(F.col("gpa")).alias("gpa"))


def breadth_matched(taken: DataFrame, areas: DataFrame) -> DataFrame:
    """(student, area, courses): areas(code, area, active), inactive ones left out."""
    rows = taken.select("student", "code").distinct().join(areas.where("active").select("code", "area").distinct(), "code")
    return rows.groupBy("student", "area").agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("courses"))


def breadth_missing(students: DataFrame, matched: DataFrame, areas: DataFrame) -> DataFrame:
    """(student, area) of areas without a course; the universe of areas comes from the data: one row an area."""
    universe = areas.where("active").agg(F.array_sort(F.collect_set("area")).alias("all"))
    every = students.join(F.broadcast(universe)).select("student", F.explode("all").alias("area"))
    return every.join(matched, ["student", "area"], "left_anti")


def breadth_unmatched(taken: DataFrame, areas: DataFrame) -> DataFrame:
    return taken.select("student", "code").distinct().join(areas.where("active").select("code"), "code", "left_anti").select("student", "code")


def area_rollup(areas: DataFrame, courses: DataFrame) -> DataFrame:
    """Courses of each area: active, removed, and units least, most and mean; with a total row (area null)."""
    rows = areas.join(courses.select("code", "units"), "code")
    return rows.rollup("area").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count_if("active").alias("n_active"), F.count_if(~F.col("active")).alias("n_removed"), F.min("units").alias("least"), F.max("units").alias("most"), F.round(F.avg("units"), 2).alias("mean"))


def recent_courses(dated: DataFrame, n: int = 5) -> DataFrame:
    """The n courses of each department with the latest year; dated(department, code, year)."""
    rank = F.row_number().over(Window.partitionBy("department").orderBy(F.col("year").desc(), "code"))
    return dated.withColumn("rank", rank).where(F.col("rank") <= n)
