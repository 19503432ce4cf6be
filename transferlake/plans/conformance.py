"""Conformance of nested records as queries; importing this module registers them with the others."""

from __future__ import annotations

from ..operators import conformance
from ..sources import schemas
from .queries import query
from .trees import CELLS

_RULES = CELLS + """, x AS (SELECT agreement AS a, part, supp, qty, p_size AS size, '$.courses[' || (row_number() OVER (PARTITION BY agreement ORDER BY pos) - 1) || ']' AS c FROM cell JOIN part ON p_partkey = part),
y AS (SELECT *, c || '.sections[0]' AS s, c || '.sections[0].schedule[0]' AS m FROM x WHERE a % 29 > 0 AND a % 37 > 0)
"""


@query(
    _RULES
    + """SELECT DISTINCT a AS program, '$' AS place, 'not JSON' AS issue FROM x WHERE a % 37 = 0
UNION ALL SELECT DISTINCT a, '$.courses', 'wrong type' FROM x WHERE a % 29 = 0 AND a % 37 > 0
UNION ALL SELECT DISTINCT a, '$', 'unexpected pages' FROM x WHERE a % 31 = 0 AND a % 37 > 0
UNION ALL SELECT a, c, 'missing course_code' FROM y WHERE part % 17 = 0
UNION ALL SELECT a, c || '.course_code', 'pattern' FROM y WHERE part % 17 > 0 AND part % 13 = 0
UNION ALL SELECT a, c || '.course_title', 'blank' FROM y WHERE part % 19 = 0
UNION ALL SELECT a, c || '.units', 'wrong type' FROM y WHERE part % 11 = 0
UNION ALL SELECT a, c || '.transfer_info[1]', 'wrong type' FROM y WHERE supp % 7 = 0
UNION ALL SELECT a, c || '.c_id', 'wrong type' FROM y WHERE size % 23 = 0
UNION ALL SELECT a, s, 'unexpected room' FROM y WHERE supp % 5 = 0
UNION ALL SELECT a, s || '.section_number', 'wrong type' FROM y WHERE qty % 3 > 0 AND qty % 7 = 0
UNION ALL SELECT a, s || '.schedule', 'empty list' FROM y WHERE qty % 10 = 0
UNION ALL SELECT a, m, 'missing days' FROM y WHERE qty % 10 > 0 AND qty % 8 = 0
UNION ALL SELECT a, m || '.time', 'pattern' FROM y WHERE qty % 10 > 0 AND qty % 9 = 0
UNION ALL SELECT a, m || '.instructor', 'blank' FROM y WHERE qty % 10 > 0 AND supp % 11 = 0"""
)
def record_conformance(spark, sf_dir):
    """Programs with planted faults at each of four levels against their schema."""
    return conformance.conformance(schemas.program_texts(spark, sf_dir), schemas.PROGRAM, "program")


def _flat(tool: str, schema: dict, path: str = "$") -> list[tuple]:
    """(tool, path, key, types, needed, low, high, above, allowed, least) for each key of a schema at every level; lists have [*] in their path."""
    out = []
    for key, s in schema["properties"].items():
        own = s
        out.append((tool, path, key, s["type"], key in schema["required"], s.get("minimum"), s.get("maximum"), s.get("exclusiveMinimum"), "|".join(s.get("enum", [])), s.get("minItems")))
        below = f"{path}.{key}"
        while own["type"] == "array":
            own, below = own["items"], below + "[*]"
            out.append((tool, below, "", own["type"], False, None, None, None, "", None))
        if own["type"] == "object":
            out += _flat(tool, own, below)
    return out


_LITERAL = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
_ROWS = lambda rows: ", ".join("(" + ", ".join(map(_LITERAL, r)) + ")" for r in rows)
_CLOSED = [(t, p) for t, s in schemas.TOOLS.items() for p in ["$"] + (["$.planned_courses[*]"] if t == "gpa_projection" else [])]


@query(
    f"""WITH RECURSIVE r(tool, path, key, type, needed, low, high, above, allowed, least) AS (VALUES {_ROWS([row for t, s in schemas.TOOLS.items() for row in _flat(t, s)])}),
closed(tool, path) AS (VALUES {_ROWS(_CLOSED)}), t(tool, variant, args) AS (VALUES {_ROWS(schemas.argument_texts())}),
names(i, tool) AS (VALUES {_ROWS(list(enumerate(schemas.TOOLS)))}),
n AS (SELECT event_id AS node, CASE WHEN event_id % 47 = 0 THEN 'weather' WHEN event_id % 53 = 0 THEN '{schemas.FREE_STEP}' ELSE names.tool END AS tool, ((event_id // {len(schemas.TOOLS)}) % 6)::INT AS v FROM events JOIN names ON i = event_id % {len(schemas.TOOLS)}),
a AS (SELECT tool, variant, CASE WHEN json_valid(args) THEN args::JSON END AS j FROM t),
walk(tool, variant, pattern, place, j) AS (
  SELECT tool, variant, '$', '$', j FROM a WHERE j IS NOT NULL
  UNION ALL (
    WITH w AS (SELECT * FROM walk),
    o AS (SELECT w.*, unnest(json_keys(w.j)) AS k FROM w WHERE json_type(w.j) = 'OBJECT'), l AS (SELECT w.*, unnest(range(json_array_length(w.j)::INT)) AS i FROM w WHERE json_type(w.j) = 'ARRAY')
    SELECT tool, variant, pattern || '.' || k, place || '.' || k, json_extract(j, '$.' || k) FROM o UNION ALL SELECT tool, variant, pattern || '[*]', place || '[' || i || ']', json_extract(j, '$[' || i || ']') FROM l)),
typed AS (SELECT w.*, r.*, CASE json_type(w.j) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'other' END AS own
  FROM walk w JOIN r ON r.tool = w.tool AND w.pattern = CASE WHEN key = '' THEN path ELSE path || '.' || key END),
bad AS (SELECT *, NOT (own = type OR (type = 'number' AND own = 'integer')) AS wrong FROM typed),
shut AS (SELECT tool, variant, place FROM bad WHERE wrong),
f AS (
  SELECT tool, variant, place, 'wrong type' AS issue FROM bad WHERE wrong
  UNION ALL SELECT tool, variant, place, 'out of range' FROM bad WHERE NOT wrong AND (j::DOUBLE < low OR j::DOUBLE > high OR j::DOUBLE <= above) AND own IN ('integer', 'number')
  UNION ALL SELECT tool, variant, place, 'not allowed' FROM bad WHERE NOT wrong AND allowed <> '' AND NOT list_contains(string_split(allowed, '|'), j ->> '$')
  UNION ALL SELECT tool, variant, place, 'empty list' FROM bad WHERE NOT wrong AND least > json_array_length(j)
  UNION ALL SELECT w.tool, w.variant, w.place, 'missing ' || key FROM walk w JOIN r ON r.tool = w.tool AND r.path = w.pattern WHERE needed AND json_type(w.j) = 'OBJECT' AND NOT list_contains(json_keys(w.j), key)
  UNION ALL SELECT w.tool, w.variant, w.place, 'unexpected ' || k FROM (SELECT *, unnest(json_keys(j)) AS k FROM walk WHERE json_type(j) = 'OBJECT') w JOIN closed c ON c.tool = w.tool AND c.path = w.pattern WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tool = w.tool AND r.path = w.pattern AND r.key = w.k)
  UNION ALL SELECT tool, variant, '$', 'missing any of instructor_name, department, course_code' FROM a WHERE tool = 'professor_rating' AND len(list_intersect(json_keys(j), ['instructor_name', 'department', 'course_code'])) = 0
  UNION ALL SELECT tool, variant, '$', 'not JSON' FROM a WHERE j IS NULL),
kept AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM shut s WHERE s.tool = f.tool AND s.variant = f.variant AND (starts_with(f.place, s.place || '.') OR starts_with(f.place, s.place || '['))))
SELECT node, place, issue FROM n JOIN kept ON kept.tool = n.tool AND kept.variant = n.v UNION ALL SELECT node, 'tool', 'unknown tool' FROM n WHERE tool = 'weather'"""
)
def tool_conformance(spark, sf_dir):
    """Arguments of plan nodes against the schemas of fifteen tools."""
    return conformance.tool_conformance(schemas.plan_nodes(spark, sf_dir), schemas.TOOLS, schemas.FREE_STEP)
