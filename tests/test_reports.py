"""Audit reports, the five tiers and conformance on hand-made rows."""

import json
import random

from pyspark.sql import functions as F

from transferlake.operators import cascade, conformance, reports
from transferlake.sources import schemas


def test_audit_report_says_why(spark):
    keys = "student long, agreement long, group_id int, section_id string, place int, uc_course string, options array<array<string>>"
    rows = [(1, 1, 1, "A", 0, "U 1", [["a", "b"], ["c"]]), (1, 1, 1, "A", 1, "U 2", [["c", "x"], ["d", "a"]]), (1, 1, 1, "A", 2, "U 3", []), (1, 1, 2, "A", 0, "U 4", [["c"]]), (1, 1, 2, "A", 1, "U 5", [["x"], ["y"]]), (1, 1, 2, "B", 0, "U 6", None), (2, 1, 1, "A", 0, "U 1", [["a", "b"], ["c"]]), (None, 1, 1, "A", 0, "U 1", [["c"]]), (1, 2, 1, "A", 0, "U 1", [["c"]])]
    taken = spark.createDataFrame([(1, "c"), (1, "c"), (1, "a"), (1, "AP BIO"), (None, "c")], "student long, code string")
    got = {(r.student, r.agreement, r.group_id, r.section_id, r.place): tuple(r)[6:] for r in reports.audit_report(spark.createDataFrame(rows, keys), taken).collect()}
    note = reports.OUTSIDE_NOTE
    assert got == {
        (1, 1, 1, "A", 0): ("satisfied", 100.0, "c", "", "c", note),
        (1, 1, 1, "A", 1): ("partial", 50.0, "", "x", "", note),
        (1, 1, 1, "A", 2): ("missing", 0.0, "", "no course articulated", "", note),
        (1, 1, 2, "A", 0): ("satisfied", 100.0, "c", "", "c", note),
        (1, 1, 2, "A", 1): ("missing", 0.0, "", "x", "", note),
        (1, 1, 2, "B", 0): ("missing", 0.0, "", "no course articulated", "", note),
        (2, 1, 1, "A", 0): ("missing", 0.0, "", "a, b", "", ""),
        (None, 1, 1, "A", 0): ("missing", 0.0, "", "c", "", ""),
        (1, 2, 1, "A", 0): ("satisfied", 100.0, "c", "", "", note),
    }


def test_later_tiers_are_asked_less(spark):
    docs = spark.createDataFrame([(1, "g", "A", "U 1", ["c1"]), (2, "g", "B", "U 2", ["c2"]), (3, "h", "A", "U 1", ["c3"]), (4, "h", "A", "U 1", ["c9"])], "doc long, grp string, section string, uc string, ccc array<string>")
    asked = [(1, "g", "B", None, None), (2, "g", "C", None, None), (3, None, None, ["U 1", "U 1"], ["c3"]), (4, "none", "A", ["U 2"], ["zz"]), (5, None, None, ["U 9"], ["c2"]), (6, None, None, None, ["c1", "c2"]), (7, None, None, [], []), (8, "none", None, ["U 9"], ["zz"])]
    questions = spark.createDataFrame(asked, "query long, grp string, section string, uc array<string>, ccc array<string>")
    seen = []

    def nearest(left):
        seen.append(sorted(r.query for r in left.collect()))
        return left.select("query", F.lit(4).cast("long").alias("doc"), F.lit(1).alias("place")).where("query = 7")

    got, counts = cascade.cascade(questions, docs, nearest)
    assert sorted((r.query, r.tier, r.rank, r.doc) for r in got.collect()) == [(1, 1, 1, 2), (2, 2, 1, 1), (2, 2, 2, 2), (3, 3, 1, 3), (4, 3, 1, 2), (5, 4, 1, 2), (6, 3, 1, 1), (6, 3, 2, 2), (7, 5, 1, 4)]
    assert seen == [[7, 8]] and list(counts.values()) == [8, 7, 6, 3, 2]
    none, counts = cascade.cascade(questions.limit(0), docs, nearest)
    assert none.count() == 0 and list(counts.values()) == [0]


def brute(schema, value, place="$"):
    types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    kind = "null" if value is None else {str: "string", bool: "boolean", int: "integer", float: "number", list: "array", dict: "object"}[type(value)]
    if not (kind in types or (kind == "integer" and "number" in types)):
        return [(place, "wrong type")]
    out = []
    if kind == "object":
        out += [(place, f"missing {k}") for k in schema.get("required", []) if k not in value]
        if "anyRequired" in schema and not set(schema["anyRequired"]) & set(value):
            out.append((place, "missing any of " + ", ".join(schema["anyRequired"])))
        for k, v in value.items():
            if k in schema["properties"]:
                out += brute(schema["properties"][k], v, f"{place}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append((place, f"unexpected {k}"))
    if kind == "array":
        out += [(place, "empty list")] * (len(value) < schema.get("minItems", 0))
        out += [x for i, v in enumerate(value) if "items" in schema for x in brute(schema["items"], v, f"{place}[{i}]")]
    if kind == "string":
        import re

        blank = not value.strip()
        out += [(place, "blank")] * (blank and bool(schema.get("minLength")))
        out += [(place, "pattern")] * ("patterns" in schema and not blank and not any(re.search(p, value) for p in schema["patterns"]))
        out += [(place, "not allowed")] * ("enum" in schema and value not in schema["enum"])
    if kind in ("integer", "number"):
        out += [(place, "out of range")] * sum([value < schema.get("minimum", value), value > schema.get("maximum", value), "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]])
    return out


def made(rng, schema, fault):
    """A value of the schema, and now and then one that is not."""
    if rng.random() < fault:
        return rng.choice([None, 3, -1.5, "", "text", [], [1], {}, {"x": None}, True])
    kind = schema["type"] if isinstance(schema["type"], str) else rng.choice(schema["type"])
    if kind == "object":
        value = {k: made(rng, s, fault) for k, s in schema["properties"].items() if k in schema["required"] or rng.random() < 0.5}
        if value and rng.random() < fault:
            value.pop(rng.choice(list(value)))
        return value | ({"extra": 1} if rng.random() < fault else {})
    if kind == "array":
        return [made(rng, schema["items"], fault) for _ in range(rng.randrange(0, 3))]
    return {"string": rng.choice(["MATH 7", "3 UNITS", "9:00a.m.-9:50a.m.", "MW", "uc", " "]), "null": None, "integer": rng.randrange(-1, 25), "number": rng.choice([0, 2.5, 5])}[kind]


def test_compiled_rules_find_what_a_walk_finds(spark):
    rng = random.Random(9)
    values = [made(rng, schemas.PROGRAM, 0.04) for _ in range(200)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{"), (901, None)], "key long, text string")
    got = sorted(tuple(r) for r in conformance.conformance(rows, schemas.PROGRAM, "key").collect())
    assert got == sorted([(i, *x) for i, v in enumerate(values) for x in brute(schemas.PROGRAM, v)] + [(900, "$", "not JSON"), (901, "$", "not JSON")])
    nodes = [(i, t, made(rng, s, 0.1)) for i, (t, s) in enumerate(list(schemas.TOOLS.items()) * 12)]
    frame = spark.createDataFrame([(i, t, json.dumps(v)) for i, t, v in nodes] + [(900, "weather", "{}"), (901, None, "{}"), (902, schemas.FREE_STEP, "x")], "node long, tool string, args string")
    got = sorted(tuple(r) for r in conformance.tool_conformance(frame, schemas.TOOLS, schemas.FREE_STEP).collect())
    assert got == sorted([(i, *x) for i, t, v in nodes for x in brute(schemas.TOOLS[t], v)] + [(900, "tool", "unknown tool"), (901, "tool", "missing tool")])
