"""Records as JSON text against schema documents: each document is compiled into one expression, so that all rules of all levels are one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the types of a schema's single values are called in a value's own schema.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE"], "boolean": ["BOOLEAN"]}
FOUND = "array<struct<place:string,issue:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) as an array, with the value made once: as a lambda's argument it is not written out again at each use."""
    return F.flatten(F.transform(F.array(value), use))


def _said(place: Column, *rules: tuple[Column, str | Column]) -> Column:
    """An issue at the place for each rule that is broken; a list of them is made only where there is one."""
    issues = [F.when(broken, F.struct(place.alias("place"), (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"))) for broken, issue in rules]
    return F.when(reduce(or_, (broken for broken, _ in rules)), F.array_compact(F.array(*issues))).otherwise(F.array().cast(FOUND))


def _named(place: Column, what: str, keys: Column) -> Column:
    """An issue at the place for each of the keys."""
    return F.transform(keys, lambda k: F.struct(place.alias("place"), F.concat(F.lit(what + " "), k).alias("issue")))


def _together(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts)) if parts else F.array().cast(FOUND)


def _is(kind: Column, name: str) -> Column:
    """Whether a value's own schema is of a type that is no list and no object; decimals carry their digits."""
    return kind.isin(KINDS[name]) | F.startswith(kind, F.lit("DECIMAL")) if name == "number" else kind.isin(KINDS[name])


def violations(schema: dict, value: Column, place: Column) -> Column:
    """array<struct<place, issue>> of a variant against a schema: types, required and unexpected keys, items, patterns (one must match), blank texts, empty lists, ranges and allowed values, at every level.

    A value of the wrong type is one issue and is not looked into; one that is absent, null in SQL, has none. A list and an object are known by being read as one, which is done once; a value's own
    schema is asked for only where a single value may stand, since that of a list or an object walks through all it holds, again at each level.
    """
    types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    wrong, empty = _said(place, (F.lit(True), "wrong type")), F.array().cast(FOUND)
    single = [t for t in types if t in KINDS]

    def judged(value: Column) -> Column:
        found = wrong
        if "null" in types:
            found = F.when(F.is_variant_null(value), empty).otherwise(found)
        if single:
            rules = lambda kind: _single(schema, single, value, kind, place)
            found = _bound(F.schema_of_variant(value), lambda kind: F.when(reduce(or_, (_is(kind, t) for t in single)), rules(kind)).otherwise(found))
        if "array" in types:
            other = found
            found = _bound(F.try_variant_get(value, "$", "array<variant>"), lambda held: F.when(held.isNotNull(), _list(schema, held, place)).otherwise(other))
        if "object" in types:
            above = found
            found = _bound(F.try_variant_get(value, "$", "map<string,variant>"), lambda held: F.when(held.isNotNull(), _object(schema, held, place)).otherwise(above))
        return F.when(value.isNull(), empty).otherwise(found)

    return _bound(value, judged)


def _single(schema: dict, types: list[str], value: Column, kind: Column, place: Column) -> Column:
    """Issues of a text, number or truth value that is of one of the types."""
    parts = []
    if "string" in types and any(schema.get(x) for x in ("minLength", "patterns", "enum")):

        def of_text(text: Column) -> Column:
            rules = []
            if schema.get("minLength"):
                rules.append((~text.rlike(r"[^ \t\r\n]"), "blank"))
            if patterns := schema.get("patterns"):
                rules.append((~reduce(or_, map(text.rlike, patterns)) & (F.trim(text) != ""), "pattern"))
            if allowed := schema.get("enum"):
                rules.append((~text.isin(allowed), "not allowed"))
            return _said(place, *rules)

        parts.append(_bound(F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), of_text))
    if {"number", "integer"} & set(types):
        low, high, above = (schema.get(x) for x in ("minimum", "maximum", "exclusiveMinimum"))
        broken = lambda n: [n < low] * (low is not None) + [n > high] * (high is not None) + [n <= above] * (above is not None)
        if broken(F.lit(0)):
            parts.append(_bound(F.when(_is(kind, "number"), F.try_variant_get(value, "$", "double")), lambda n: _said(place, *((b, "out of range") for b in broken(n)))))
    return _together(parts)


def _list(schema: dict, held: Column, place: Column) -> Column:
    """Issues of a list and of what it holds."""
    own = [_said(place, (F.size(held) < schema["minItems"], "empty list"))] if schema.get("minItems") else []
    below = [F.flatten(F.transform(held, lambda x, i: violations(schema["items"], x, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")))))] if "items" in schema else []
    return _together(own + below)


def _object(schema: dict, held: Column, place: Column) -> Column:
    """Issues of an object and of the values of its keys."""
    listed = lambda names: F.array(*map(F.lit, names))

    def inside(keys: Column) -> Column:
        parts = [_named(place, "missing", F.array_except(listed(needed), keys))] if (needed := schema.get("required")) else []
        if some := schema.get("anyRequired"):
            parts.append(_said(place, (~F.arrays_overlap(keys, listed(some)), "missing any of " + ", ".join(some))))
        if schema.get("additionalProperties") is False:
            parts.append(_named(place, "unexpected", F.array_except(keys, listed(schema["properties"]))))
        return _together(parts + [violations(s, held[k], F.concat(place, F.lit("." + k))) for k, s in schema.get("properties", {}).items()])

    return _bound(F.map_keys(held), inside)


def conformance(rows: DataFrame, schema: dict, key: str, text: str = "text") -> DataFrame:
    """(key, place, issue): an issue for each rule that a record breaks, the record being JSON text. Text that is no JSON, and null, is one issue."""
    parsed = rows.select(key, F.try_parse_json(text).alias("v"))
    found = F.when(F.col("v").isNull(), _said(F.lit("$"), (F.lit(True), "not JSON"))).otherwise(violations(schema, F.col("v"), F.lit("$")))
    return parsed.select(key, F.explode(found).alias("x")).select(key, "x.place", "x.issue")


def tool_conformance(nodes: DataFrame, schemas: dict[str, dict], free: str) -> DataFrame:
    """(node, place, issue) of nodes(node, tool, args): arguments against the schema of their tool; a free step takes anything, a tool without a schema is unknown."""
    parsed = nodes.select("node", "tool", F.try_parse_json("args").alias("v"))
    found = _said(F.lit("tool"), (F.lit(True), "unknown tool"))
    for tool, schema in schemas.items():
        own = F.when(F.col("v").isNull(), _said(F.lit("$"), (F.lit(True), "not JSON"))).otherwise(violations(schema, F.col("v"), F.lit("$")))
        found = F.when(F.col("tool") == tool, own).otherwise(found)
    found = F.when(F.col("tool").isNull(), _said(F.lit("tool"), (F.lit(True), "missing tool"))).when(F.col("tool") == free, F.array().cast(FOUND)).otherwise(found)
    return parsed.select("node", F.explode(found).alias("x")).select("node", "x.place", "x.issue")
