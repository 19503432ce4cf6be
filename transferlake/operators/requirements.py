"""Which students satisfy which requirements: relational division and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def option_progress(options: DataFrame, taken: DataFrame) -> DataFrame:
    """(student, requirement, option, matched, required) where a student has one course of the option at least.

    It starts from matched courses, so pairs without any never exist. options(requirement, option, code) is joined on
    the course; repeated rows on either side count once.
    """
    wanted = options.select("requirement", "option", "code").distinct()
    sizes = wanted.groupBy("requirement", "option").agg(F.count("*").alias("required"))
    matched = wanted.join(taken.select("student", "code").distinct(), "code").groupBy("student", "requirement", "option").agg(F.count("*").alias("matched"))
    return matched.join(sizes, ["requirement", "option"]).select("student", "requirement", "option", "matched", "required")


def satisfied(progress: DataFrame) -> DataFrame:
    """(student, requirement, option): the first option, all of whose courses the student has."""
    return progress.where("matched = required").groupBy("student", "requirement").agg(F.min("option").alias("option"))


def missing(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Target pairs (student, requirement) without a satisfied option."""
    return targets.join(done, ["student", "requirement"], "left_anti").select("student", "requirement")


def best_partial(progress: DataFrame, options: DataFrame, taken: DataFrame) -> DataFrame:
    """For pairs not satisfied, the option matched most: percentage and the courses it lacks.

    Best and satisfied come from one aggregate. What an option lacks is its list of courses less that of the student, so that nothing is made of pairs and courses; all is by student, and rows dealt by student stay where they are.
    """
    share = F.round(F.col("matched") * 100.0 / F.col("required"), 2)
    best = progress.groupBy("student", "requirement").agg(F.max_by(F.struct("option", share.alias("percent")), F.struct(share, -F.col("option"))).alias("b"), F.bool_or(F.col("matched") == F.col("required")).alias("done"))
    best = best.where("not done").select("student", "requirement", "b.option", "b.percent")
    wanted = options.groupBy("requirement", "option").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    has = taken.groupBy("student").agg(F.collect_set("code").alias("has"))
    lacks = best.join(wanted, ["requirement", "option"]).join(has, "student").withColumn("lacks", F.array_except("codes", "has")).where(F.size("lacks") > 0)
    return lacks.select("student", "requirement", "option", "percent", F.array_join("lacks", ", ").alias("lacking"))


def group_status(done: DataFrame, members: DataFrame) -> DataFrame:
    """(student, grp, satisfied) for students with one satisfied requirement of the group at least.

    members(requirement, grp, section, logic, n): all_required wants every requirement, select_n_courses n of
    them, choose_one_section exactly one section that is complete.
    """
    sizes = members.groupBy("grp", "section").agg(F.count("*").alias("size"))
    totals = members.groupBy("grp").agg(F.count("*").alias("total"), F.min("logic").alias("logic"), F.min("n").alias("n"))
    per_section = done.join(members, "requirement").groupBy("student", "grp", "section").agg(F.count("*").alias("met")).join(sizes, ["grp", "section"])
    per_group = per_section.groupBy("student", "grp").agg(F.sum("met").alias("met"), F.count_if(F.col("met") == F.col("size")).alias("complete")).join(totals, "grp")
    ok = F.when(F.col("logic") == "all_required", F.col("met") == F.col("total")).when(F.col("logic") == "select_n_courses", F.col("met") >= F.col("n")).otherwise(F.col("complete") == 1)
    return per_group.select("student", "grp", "logic", ok.alias("satisfied"))


def reused_courses(done: DataFrame, options: DataFrame) -> DataFrame:
    """Courses that count towards several satisfied requirements of one student."""
    used = done.join(options, ["requirement", "option"]).select("student", "code", "requirement").distinct()
    return used.groupBy("student", "code").agg(F.count("*").alias("uses")).where("uses > 1")


def honors_required(options: DataFrame) -> DataFrame:
    """(requirement, honors_required): every option has an honors course; options(requirement, option, code, honors)."""
    per = options.groupBy("requirement", "option").agg(F.bool_or("honors").alias("h"))
    return per.groupBy("requirement").agg(F.bool_and("h").alias("honors_required"))


def logic_summary(options: DataFrame) -> DataFrame:
    """Options of each requirement: how many, how many with several courses, sizes, and their text."""
    per = options.groupBy("requirement", "option").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("code")), " AND ").alias("text"))
    return per.groupBy("requirement").agg(
        F.count("*").alias("options"),
        F.count_if(F.col("n") > 1).alias("multi_course_options"),
        F.min("n").alias("fewest"),
        F.max("n").alias("most"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("option", "text"))), lambda x: x["text"]), " OR ").alias("options_text"),
    )


def reverse_match(options: DataFrame) -> DataFrame:
    """(code, direct, contributing): requirements that a course satisfies alone, and others that it helps with."""
    sizes = options.groupBy("requirement", "option").agg(F.count("*").alias("n"))
    rows = options.join(sizes, ["requirement", "option"])
    sets = rows.groupBy("code").agg(F.collect_set(F.when(F.col("n") == 1, F.col("requirement"))).alias("d"), F.collect_set(F.when(F.col("n") > 1, F.col("requirement"))).alias("c"))
    joined = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    return sets.select("code", joined(F.col("d")).alias("direct"), joined(F.array_except("c", "d")).alias("contributing"))


def compare_options(options: DataFrame, pairs: DataFrame) -> DataFrame:
    """Options of two requirements side by side: pairs(left_req, right_req) to (.., option_text, side)."""
    text = options.groupBy("requirement", "option").agg(F.array_join(F.array_sort(F.collect_set("code")), " + ").alias("option_text")).select("requirement", "option_text").distinct()
    left = pairs.join(text, pairs.left_req == text.requirement).select("left_req", "right_req", "option_text", F.lit(1).alias("l"))
    right = pairs.join(text, pairs.right_req == text.requirement).select("left_req", "right_req", "option_text", F.lit(1).alias("r"))
    both = left.join(right, ["left_req", "right_req", "option_text"], "full")
    return both.select("left_req", "right_req", "option_text", F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def audit(targets: DataFrame, progress: DataFrame) -> DataFrame:
    """Every target pair as satisfied, partial or missing, with the best percentage and whether the student has all."""
    best = progress.groupBy("student", "requirement").agg(F.max(F.round(F.col("matched") * 100.0 / F.col("required"), 2)).alias("percent"))
    rows = targets.join(best, ["student", "requirement"], "left").withColumn("percent", F.coalesce("percent", F.lit(0.0)))
    status = F.when(F.col("percent") == 100, "satisfied").when(F.col("percent") > 0, "partial").otherwise("missing")
    everything = F.bool_and(F.col("percent") == 100).over(Window.partitionBy("student"))
    return rows.select("student", "requirement", "percent", status.alias("status"), everything.alias("all_satisfied"))
