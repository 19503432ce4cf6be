"""Facts about agreements: their options, sections, mappings and courses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def _joined(values: Column, between: str = ", ") -> Column:
    return F.array_join(F.transform(F.array_sort(values), lambda x: x.cast("string")), between)


def logic_stats(options: DataFrame) -> DataFrame:
    """Per requirement: options of several courses, whether options are alternatives, courses, and nesting (2 with both)."""
    sizes = options.groupBy("requirement", "option").agg(F.count("*").alias("n"))
    return sizes.groupBy("requirement").agg(
        F.count_if(F.col("n") > 1).alias("and_blocks"),
        (F.count("*") > 1).cast("int").alias("or_blocks"),
        F.sum("n").alias("courses"),
        ((F.max("n") > 1).cast("int") + (F.count("*") > 1).cast("int")).alias("nesting"),
    )


def shared_courses(required: DataFrame) -> DataFrame:
    """(code, majors) of required(major, code): courses of several majors, and those majors."""
    return required.groupBy("code").agg(F.collect_set("major").alias("m")).where(F.size("m") > 1).select("code", _joined(F.col("m")).alias("majors"))


def alternative_paths(required: DataFrame) -> DataFrame:
    """(major, shared, others): a major's courses that other majors have, and those majors."""
    sets = required.groupBy("code").agg(F.collect_set("major").alias("m")).where(F.size("m") > 1)
    rows = required.distinct().join(sets, "code")
    per = rows.groupBy("major").agg(F.collect_set("code").alias("c"), F.array_distinct(F.flatten(F.collect_list("m"))).alias("m"))
    return per.select("major", _joined(F.col("c")).alias("shared"), _joined(F.array_except("m", F.array("major"))).alias("others"))


def course_mappings(options: DataFrame) -> DataFrame:
    """(receiving, sending, status, kind, majors, n_majors): equal mappings of several majors as one; options(major, receiving, option, code, status)."""
    per = options.groupBy("major", "receiving", "option", "status").agg(F.collect_set("code").alias("c"))
    per = per.select("major", "receiving", "status", _joined(F.col("c"), " AND ").alias("sending"), F.when(F.size("c") > 1, "AND").otherwise("single").alias("kind"))
    return per.groupBy("receiving", "sending", "status", "kind").agg(_joined(F.collect_set("major")).alias("majors"), F.count_distinct("major").alias("n_majors"))


def requirement_stats(rows: DataFrame) -> DataFrame:
    """Per group of rows(grp, requirement, transferable, needed): options, difficulty = needed / transferable options, one status or ``mixed``."""
    ok = F.count_if("transferable")
    status = F.when(ok == F.count("*"), "transferable").when(ok == 0, "non-transferable").otherwise("mixed")
    return rows.groupBy("grp").agg(
        F.count("*").alias("options"), ok.alias("transferable"), (F.count("*") - ok).alias("non_transferable"), F.round(F.max("needed") / F.greatest(ok, F.lit(1)), 4).alias("difficulty"), status.alias("status")
    )


def redundant_courses(taken: DataFrame) -> DataFrame:
    """(student, base): students with both a course and its honors version, whose code has an H behind the number."""
    base = F.regexp_replace("code", r"(\d)H$", "$1")
    per = taken.select("student", base.alias("base"), (F.col("code") != base).alias("h")).groupBy("student", "base")
    return per.agg(F.bool_or("h").alias("with_h"), F.bool_or(~F.col("h")).alias("plain")).where("with_h and plain").select("student", "base")


def course_dictionary(mentions: DataFrame) -> DataFrame:
    """(code, title, side, units): facts from the first document of mentions(doc, code, title, side, units) that has the code."""
    first = mentions.groupBy("code").agg(F.min_by(F.struct("title", "side", "units"), F.struct("doc", "side", "title")).alias("f"))
    return first.select("code", "f.title", "f.side", "f.units")


def honors_split(options: DataFrame) -> DataFrame:
    """(requirement, honors, plain): sorted codes of each kind; options(requirement, code, honors)."""
    return options.groupBy("requirement").agg(_joined(F.collect_set(F.when(F.col("honors"), F.col("code")))).alias("honors"), _joined(F.collect_set(F.when(~F.col("honors"), F.col("code")))).alias("plain"))


def options_list(options: DataFrame) -> DataFrame:
    """(requirement, listing): ``A [single]; B + C [group, honors]`` in the order of options."""
    per = options.groupBy("requirement", "option").agg(F.collect_set("code").alias("c"), F.bool_or("honors").alias("h"))
    kind = F.concat(F.when(F.size("c") > 1, "group").otherwise("single"), F.when(F.col("h"), ", honors").otherwise(""))
    text = F.concat(_joined(F.col("c"), " + "), F.lit(" ["), kind, F.lit("]"))
    rows = per.select("requirement", F.struct("option", text.alias("text")).alias("o"))
    return rows.groupBy("requirement").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["text"]), "; ").alias("listing"))


def requirement_profile(options: DataFrame, requirements: DataFrame) -> DataFrame:
    """Per group: requirements with and without options, with several options, and with options of several courses."""
    sizes = options.groupBy("requirement", "option").agg(F.count("*").alias("n"))
    per = sizes.groupBy("requirement").agg(F.count("*").alias("options"), F.max("n").alias("most"))
    rows = requirements.join(per, "requirement", "left")
    return rows.groupBy("grp").agg(F.count("options").alias("articulated"), F.count_if(F.col("options").isNull()).alias("not_articulated"), F.count_if(F.col("options") > 1).alias("or_groups"), F.count_if(F.col("most") > 1).alias("and_groups"))


def path_completion(chosen: DataFrame, sections: DataFrame) -> DataFrame:
    """(student, section, kind, missing, extra): chosen(student, code) against sections(section, code).

    exact: the same courses; partial: only some of the section's; over-complete: all of it and more. Others give no row.
    """
    mine = chosen.groupBy("student").agg(F.collect_set("code").alias("own"))
    theirs = sections.groupBy("section").agg(F.collect_set("code").alias("wanted"))
    pairs = chosen.join(sections, "code").select("student", "section").distinct().join(mine, "student").join(theirs, "section")
    lacks, extra = F.array_except("wanted", "own"), F.array_except("own", "wanted")
    kind = F.when((F.size(lacks) == 0) & (F.size(extra) == 0), "exact").when(F.size(extra) == 0, "partial").when(F.size(lacks) == 0, "over-complete")
    return pairs.select("student", "section", kind.alias("kind"), _joined(lacks).alias("missing"), _joined(extra).alias("extra")).where("kind is not null")


def compare_many(options: DataFrame, chosen: DataFrame) -> DataFrame:
    """(comparison, code, requirements, common): courses that serve the requirements of chosen(comparison, requirement), and whether all of them."""
    size = chosen.groupBy("comparison").agg(F.count_distinct("requirement").alias("size"))
    rows = chosen.join(options.select("requirement", "code").distinct(), "requirement")
    per = rows.groupBy("comparison", "code").agg(F.collect_set("requirement").alias("r")).join(size, "comparison")
    return per.select("comparison", "code", _joined(F.col("r"), ",").alias("requirements"), (F.size("r") == F.col("size")).alias("common"))


def logic_dnf(groups: DataFrame, block: int = 65_536) -> DataFrame:
    """(requirement, option, courses): one row per way to choose one alternative of each AND group; groups(requirement, grp, alternative, code).

    Ways are numbered, the last group's alternatives fastest, and each is made from its number, so that however many a requirement has, no array holds them.
    """
    alternatives = groups.groupBy("requirement", "grp", "alternative").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    per_group = alternatives.groupBy("requirement", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("alternative", "codes"))), lambda x: x["codes"]).alias("ways"))
    per = per_group.groupBy("requirement").agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "ways"))), lambda x: x["ways"]).alias("g"))
    ways = per.withColumn("n", F.aggregate("g", F.lit(1).cast("long"), lambda n, w: n * F.size(w)))
    blocks = ways.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    numbered = blocks.withColumn("option", F.explode(F.sequence("first", F.least(F.col("first") + block, F.col("n")) - 1)))
    start = F.struct(F.col("option").alias("rest"), F.array().cast("array<string>").alias("codes"))
    chosen = F.aggregate(F.reverse("g"), start, lambda held, w: F.struct(F.floor(held["rest"] / F.size(w)).cast("long").alias("rest"), F.array_union(held["codes"], F.get(w, (held["rest"] % F.size(w)).cast("int"))).alias("codes")), lambda held: held["codes"])
    return numbered.select("requirement", F.col("option").cast("int").alias("option"), F.array_join(F.array_sort(chosen), " AND ").alias("courses"))


def assign_ids(rows: DataFrame, key: str, bucket: Column, *order: str) -> DataFrame:
    """Rows with ``id``: the key, with -1, -2 .. behind it for its second and later rows in order; bucket must not fall as the order rises."""
    placed = numbered(rows, key, bucket, *order)
    return placed.withColumn("id", F.concat(F.col(key), F.when(F.col("place") > 1, F.concat(F.lit("-"), (F.col("place") - 1).cast("string"))).otherwise(""))).drop("place", "size")


def series_units(members: DataFrame) -> DataFrame:
    """(series, units, max_units, estimated): sums of members(series, least, most, own); else the series' own units; else 4 a course."""
    per = members.groupBy("series").agg(F.sum("least").alias("a"), F.sum(F.coalesce("most", "least")).alias("b"), F.max("own").alias("own"), F.count("*").alias("n"))
    known = F.col("a") > 0
    units = F.when(known, F.col("a")).otherwise(F.coalesce("own", F.col("n") * 4.0))
    return per.select("series", units.alias("units"), F.when(known & (F.col("b") > F.col("a")), F.col("b")).alias("max_units"), (~F.coalesce(known, F.lit(False)) & F.col("own").isNull()).alias("estimated"))
