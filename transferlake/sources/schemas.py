"""Schema documents, as data: catalogue programs with their courses, sections and schedules, and what each tool takes; and records with planted faults."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .agreements import cells
from .stand_ins import read

TEXT, LIST_OF_TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
WORDS = {"type": "string", "minLength": 1}
MAYBE = {"type": ["string", "null"]}

# Keys, types and patterns of catalogue records.
SCHEDULE = {
    "type": "object",
    "properties": {
        "time": {"type": "string", "patterns": [r"^\d{1,2}:\d{2}[ap]\.m\.-\d{1,2}:\d{2}[ap]\.m\.$", r"^Arrange-[\d.]+\s*Hours?$"]},
        "days": {"type": "string", "patterns": [r"^[MTWRFSUN]+$|^N$"]},
        "location": WORDS,
        "instructor": WORDS,
    },
    "required": ["time", "days", "location", "instructor"],
    "additionalProperties": False,
}
SECTION = {
    "type": "object",
    "properties": {"section_number": {"type": ["string", "integer"]}, "schedule": {"type": "array", "minItems": 1, "items": SCHEDULE}, "notes": LIST_OF_TEXTS, "modality": WORDS, "duration": MAYBE, "co_enrollment_with": MAYBE},
    "required": ["section_number", "schedule", "notes", "modality"],
    "additionalProperties": False,
}
COURSE = {
    "type": "object",
    "properties": {
        "course_code": {"type": "string", "minLength": 1, "patterns": [r"^[A-Z]{2,}\s*\d+[A-Z]?$"]},
        "course_title": WORDS,
        "units": {"type": "string", "patterns": [r"^\d+(\.\d+)?\s*UNIT(S)?$"]},
        "transfer_info": LIST_OF_TEXTS,
        "description": WORDS,
        "sections": {"type": "array", "minItems": 1, "items": SECTION},
        "special_notes": {"type": ["array", "null"], "items": {"type": "string"}},
    }
    | dict.fromkeys(["c_id", "cal_getc_area", "prerequisites", "prerequisite_notes", "corequisites", "advisory", "advisory_notes", "formerly", "same_as"], MAYBE),
    "required": ["course_code", "course_title", "units", "transfer_info", "description", "sections"],
    "additionalProperties": False,
}
PROGRAM = {
    "type": "object",
    "properties": {"program_name": WORDS, "program_description": TEXT, "courses": {"type": "array", "minItems": 1, "items": COURSE}},
    "required": ["program_name", "program_description", "courses"],
    "additionalProperties": False,
}


def _takes(required: list[str], properties: dict, **more) -> dict:
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False, **more}


# The arguments of each tool.
_PLANNED = _takes(["course_code", "units", "letter_grade"], {"course_code": TEXT, "units": {"type": "number", "minimum": 0}, "letter_grade": TEXT})
_MEETING = {"type": "object", "properties": {"days": TEXT, "time": TEXT}, "required": ["days", "time"]}
TOOLS = {
    "articulation_match": _takes(["smc_courses", "target_major"], {"smc_courses": LIST_OF_TEXTS, "target_major": TEXT}),
    "breadth_coverage": _takes(["student_courses"], {"student_courses": LIST_OF_TEXTS}),
    "course_detail": _takes(["course_code"], {"course_code": TEXT}),
    "course_search": _takes(["query"], {"query": TEXT, "top_k": {"type": "integer", "minimum": 1, "maximum": 20}}),
    "deadline_lookup": _takes(["query"], {"query": TEXT}),
    "faq_search": _takes(["query"], {"query": TEXT}),
    "glossary": _takes(["query"], {"query": TEXT}),
    "gpa_projection": _takes(["current_gpa", "units_completed", "planned_courses", "gpa_type"], {"current_gpa": {"type": "number", "minimum": 0, "maximum": 4}, "units_completed": {"type": "number", "exclusiveMinimum": 0}, "planned_courses": {"type": "array", "items": _PLANNED}, "gpa_type": {"type": "string", "enum": ["smc", "uc"]}}),
    "major_requirement": _takes(["major_name"], {"major_name": TEXT}),
    "prereq_graph": _takes(["course_code"], {"course_code": TEXT}),
    "professor_rating": _takes([], {"instructor_name": TEXT, "department": TEXT, "course_code": TEXT}, anyRequired=["instructor_name", "department", "course_code"]),
    "schedule_conflict": _takes(["sections"], {"sections": {"type": "array", "minItems": 1, "items": {"type": "array", "items": _MEETING}}}),
    "section_lookup": _takes(["course_code"], {"course_code": TEXT}),
    "unit_calculator": _takes(["course_codes"], {"course_codes": {"type": "array", "minItems": 1, "items": TEXT}}),
    "user_profile": _takes(["user_id"], {"user_id": TEXT}),
}
#: A step that is no tool and takes anything.
FREE_STEP = "llm_step"


def program_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, text): a program of courses for each order as JSON text, with faults at every level by the numbers of its lines."""
    c = cells(spark, sf_dir)
    part, supp, qty, size = (F.col(x) for x in ("part", "supp", "qty", "size"))
    join = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    say = lambda x: x.cast("string")
    time = F.when(qty % 9 == 0, "noon").when(qty % 2 == 0, "9:00a.m.-10:50a.m.").otherwise("Arrange-3 Hours")
    meeting = join('{"time": "', time, '"', F.when(qty % 8 == 0, "").otherwise(', "days": "MW"'), ', "location": "BUS 1", "instructor": "', F.when(supp % 11 == 0, "  ").otherwise("Ann"), '"}')
    section = join('{"section_number": ', F.when(qty % 3 == 0, '"A1"').when(qty % 7 == 0, "[1]").otherwise("1001"), ', "schedule": [', F.when(qty % 10 == 0, "").otherwise(meeting), '], "notes": [], "modality": "Online"', F.when(supp % 5 == 0, ', "room": null').otherwise(""), "}")
    course = join(
        "{",
        F.when(part % 17 == 0, "").otherwise(join('"course_code": "', F.when(part % 13 == 0, "code 1").otherwise(join("AB ", F.col("number"))), '", ')),
        '"course_title": "',
        F.when(part % 19 == 0, " ").otherwise(F.col("title")),
        '", "units": ',
        F.when(part % 11 == 0, "3").otherwise('"3 UNITS"'),
        ', "transfer_info": ["UC"',
        F.when(supp % 7 == 0, ", 5").otherwise(""),
        '], "description": "x", "sections": [',
        section,
        '], "c_id": ',
        F.when(size % 23 == 0, "7").when(size % 2 == 0, "null").otherwise('"C 1"'),
        "}",
    )
    listed = c.groupBy("agreement").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", course.alias("t")))), lambda x: x["t"]), ", ").alias("t"))
    a = F.col("agreement")
    text = join('{"program_name": "P', say(a), '", "program_description": "", "courses": ', F.when(a % 29 == 0, '"none"').otherwise(join("[", F.col("t"), "]")), F.when(a % 31 == 0, ', "pages": 1').otherwise(""), "}")
    return listed.select(a.alias("program"), F.when(a % 37 == 0, F.substring(text, 1, 40)).otherwise(text).alias("text"))


#: Arguments that each tool accepts.
EXAMPLES = {
    "articulation_match": {"smc_courses": ["CS 55", "MATH 7"], "target_major": "CS"},
    "breadth_coverage": {"student_courses": []},
    "course_search": {"query": "calculus", "top_k": 20},
    "gpa_projection": {"current_gpa": 3.5, "units_completed": 30, "planned_courses": [{"course_code": "MATH 8", "units": 5, "letter_grade": "A"}], "gpa_type": "uc"},
    "professor_rating": {"department": "Mathematics"},
    "schedule_conflict": {"sections": [[{"days": "MW", "time": "Arrange", "room": 5}]]},
    "unit_calculator": {"course_codes": ["MATH 7"]},
}


def argument_texts() -> list[tuple[str, int, str]]:
    """(tool, variant, args): good arguments, none, one too many, the first of the wrong type, text that is no JSON, and faults within or out of range where a tool has such."""
    out = []
    for tool, schema in TOOLS.items():
        good = EXAMPLES.get(tool, {k: "x" for k in schema["required"]})
        first = next(iter(good))
        deep = {"gpa_projection": good | {"current_gpa": 4.5, "units_completed": 0, "planned_courses": [{"units": -1, "letter_grade": 1, "course_code": "A", "x": 0}, 5], "gpa_type": "us"}, "course_search": good | {"top_k": 21}, "schedule_conflict": {"sections": [[{"days": "M"}], 3]}, "unit_calculator": {"course_codes": []}, "articulation_match": good | {"smc_courses": ["A", 2]}}.get(tool, good)
        variants = [json.dumps(good), "{}", json.dumps(good | {"x": 1}), json.dumps(good | {first: {"y": 2}}), "not json", json.dumps(deep)]
        out += [(tool, i, text) for i, text in enumerate(variants)]
    return out


def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, tool, args) of a node for each event."""
    e = F.col("event_id")
    names = F.array(*map(F.lit, TOOLS))
    tool = F.when(e % 47 == 0, "weather").when(e % 53 == 0, FREE_STEP).otherwise(F.element_at(names, (e % len(TOOLS)).cast("int") + 1))
    texts = spark.createDataFrame(argument_texts(), "of string, variant int, args string")  # a fixed table
    rows = read(spark, sf_dir, "events").select(e.alias("node"), tool.alias("tool"), (F.floor(e / len(TOOLS)) % 6).cast("int").alias("v"))
    return rows.join(F.broadcast(texts), (F.col("tool") == F.col("of")) & (F.col("v") == F.col("variant")), "left").select("node", "tool", F.coalesce("args", F.lit("{}")).alias("args"))
