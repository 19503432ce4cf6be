"""Catalogue and agreement texts as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, parsing
from ..sources import hard_lines
from ..sources import stand_ins as S
from .queries import query

CODE = "p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1)"


def _code() -> Column:
    return F.concat_ws(" ", "p_type", F.regexp_extract("p_brand", r"(\d+)", 1))


def _pick(number: str, *texts: str | Column) -> Column:
    """The text at the number of a column, by its remainder."""
    return F.element_at(F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts)), (F.col(number) % len(texts) + 1).cast("int"))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "part")


@query(f"""SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN {CODE} END AS code, CASE WHEN p_size % 4 <> 0 THEN p_name END AS title, (p_size % 5 + 1.5)::DOUBLE AS units FROM part""")
def parse_course_text(spark, sf_dir):
    size = F.col("p_size")
    said = F.concat(F.when(size % 4 != 0, F.concat(_code(), F.lit(":  "), "p_name", F.lit("\n"))).otherwise(""), F.lit("("), (size % 5 + 1).cast("string"), F.lit(".50 units)"))
    return _part(spark, sf_dir).select("p_partkey", parsing.course_text(said).alias("c")).select("p_partkey", "c.code", "c.title", "c.units")


@query(f"""SELECT p_partkey, array_to_string(list_filter([(p_size % 9)::VARCHAR || 'A', (p_size % 5)::VARCHAR || 'B', (p_size % 8)::VARCHAR, 'x'], lambda a: regexp_matches(a, '{parsing.AREA}')), ',') AS areas FROM part""")
def ge_areas(spark, sf_dir):
    s = lambda k, mark: F.concat((F.col("p_size") % k).cast("string"), F.lit(mark))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(parsing.ge_areas(F.concat_ws("  ", s(9, "A"), s(5, "B"), s(8, ""), F.lit("x"))), ",").alias("areas"))


@query(
    """WITH d AS (SELECT o_orderkey, o_orderkey % 6 AS kind, make_date(1996, month(o_orderdate), day(o_orderdate)) AS d, make_date(1996, month(o_orderdate + INTERVAL 40 DAY), day(o_orderdate + INTERVAL 40 DAY)) AS e FROM orders)
SELECT o_orderkey, (CASE WHEN kind < 4 THEN d WHEN kind = 4 THEN date_trunc('month', d)::DATE END)::VARCHAR AS starts, (CASE WHEN kind < 2 THEN d WHEN kind < 4 THEN e WHEN kind = 4 THEN last_day(d) END)::VARCHAR AS ends FROM d"""
)
def parse_event_dates(spark, sf_dir):
    day = lambda t: F.date_format(t, "MMMM d")
    first, last = day("o_orderdate"), day(F.col("o_orderdate") + F.expr("interval 40 days"))
    said = _pick("o_orderkey", first, F.concat(F.lit("By "), first), F.concat(first, F.lit(" - "), last), F.concat(first, F.lit(" to "), last), F.date_format("o_orderdate", "MMMM"), "soon")
    return S.read(spark, sf_dir, "orders").select("o_orderkey", parsing.event_dates(said, 1996).alias("r")).select("o_orderkey", F.col("r.starts").cast("string").alias("starts"), F.col("r.ends").cast("string").alias("ends"))


def _sql_map(names: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"


def _sql_words(text: str, names: dict[str, str]) -> str:
    return rf"array_to_string(list_transform(regexp_split_to_array({text}, '\s+'), lambda w: coalesce({_sql_map(names)}[w], w)), ' ')"


def _sql_clean(text: str) -> str:
    out = _sql_words(text, parsing.TYPOS)
    for short in sorted(parsing.ABBREVIATIONS, key=len, reverse=True):
        out = rf"regexp_replace({out}, '\b{short}\b', '{parsing.ABBREVIATIONS[short]}', 'g')"
    return f"trim({_sql_words(out, parsing.LEVEL_WORDS)})"


QUESTION = "SELECT p_partkey, list_extract(['Intro to  Calculas', 'basic comp sci', 'ART HIST and hist', 'upper chem math', 'programing for cs'], p_partkey % 5 + 1) || ' ' || p_name AS q FROM part"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _pick("p_partkey", "Intro to  Calculas", "basic comp sci", "ART HIST and hist", "upper chem math", "programing for cs")
    return _part(spark, sf_dir).select("p_partkey", F.concat(said, F.lit(" "), "p_name").alias("q"))


@query(f"SELECT p_partkey, {_sql_clean('trim(lower(q))')} AS query FROM ({QUESTION})")
def query_cleanup(spark, sf_dir):
    return _questions(spark, sf_dir).select("p_partkey", parsing.clean_query(F.col("q")).alias("query"))


_SWAPS = ", ".join(f"CASE WHEN contains(q, '{s}') THEN replace(q, '{s}', '{o}') END" for s, others in parsing.SYNONYMS.items() for o in others)
_BARE = r"array_to_string(list_filter(regexp_split_to_array(q, '\s+'), lambda w: w NOT IN ('introduction', 'intermediate', 'advanced')), ' ')"


@query(
    f"""WITH c AS (SELECT p_partkey, {_sql_clean('trim(lower(q))')} AS q FROM ({QUESTION})),
v AS (SELECT p_partkey, list_filter([q, {_SWAPS}, CASE WHEN regexp_matches(q, 'introduction|intermediate|advanced') THEN nullif({_BARE}, '') END], lambda x: x IS NOT NULL) AS l FROM c),
d AS (SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM v)
SELECT p_partkey, (i - 1)::INT AS variant_no, l[i] AS variant FROM d, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)"""
)
def query_variants(spark, sf_dir):
    clean = _questions(spark, sf_dir).select("p_partkey", parsing.clean_query(F.col("q")).alias("q"))
    return clean.select("p_partkey", F.posexplode(parsing.query_variants(F.col("q"))).alias("variant_no", "variant"))


TERM = f"t AS (SELECT p_partkey, list_extract([p_name || ' (' || p_type || ')', p_name || ' / ' || {CODE}, p_name], p_partkey % 3 + 1) AS term, p_brand AS other FROM part)"


@query(
    f"""WITH {TERM}, a AS (SELECT p_partkey, 1 AS rule, lower(other) AS alias, lower(term) AS canonical FROM t
UNION ALL SELECT p_partkey, 2, lower(regexp_extract(term, '\\(([^)]+)\\)$', 1)), lower(term) FROM t WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 3, lower(trim(split_part(term, '/', 1))), lower(trim(split_part(term, '/', 2))) FROM t WHERE contains(term, '/')
UNION ALL SELECT p_partkey, 4, lower(trim(split_part(term, '/', 2))), lower(trim(split_part(term, '/', 1))) FROM t WHERE contains(term, '/')
UNION ALL SELECT p_partkey, 5, i, lower(term) FROM (SELECT *, lower(array_to_string(list_transform(regexp_extract_all(term, '([A-Za-z]+)', 1), lambda w: w[1]), '')) AS i FROM t) WHERE length(i) BETWEEN 2 AND 6)
SELECT alias, canonical FROM a QUALIFY row_number() OVER (PARTITION BY alias ORDER BY p_partkey DESC, rule DESC) = 1"""
)
def alias_map(spark, sf_dir):
    term = _pick("p_partkey", F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), F.concat(F.col("p_name"), F.lit(" / "), _code()), F.col("p_name"))
    rows = _part(spark, sf_dir).select("p_partkey", F.explode(parsing.aliases(term, F.array("p_brand"))).alias("a"))
    return rows.groupBy("a.alias").agg(F.max_by("a.canonical", F.struct("p_partkey", "a.rule")).alias("canonical"))


@query("SELECT doc_id, array_to_string(list_filter(['and', 'tion', 'transfer', 'unit'], lambda w: contains(lower(text), w)), ',') AS keywords FROM documents")
def domain_keywords(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.array_join(parsing.domain_keywords(F.col("text"), ["unit", "transfer", "and", "tion"]), ",").alias("keywords"))


@query(f"SELECT p_partkey, list_extract(['BS', NULL, 'MINOR', 'AA-T'], p_partkey % 4 + 1) AS degree, p_type AS subject FROM part")
def degree_type(spark, sf_dir):
    said = _pick("p_partkey", F.concat("p_name", F.lit(" bs")), F.concat("p_name", F.lit(" B.S.")), F.concat(F.lit("Minor in "), "p_name"), F.concat(F.lit("AA-T "), "p_name"))
    return _part(spark, sf_dir).select("p_partkey", parsing.degree_type(said).alias("degree"), parsing.subject_prefix(_code()).alias("subject"))


@query("SELECT doc_id, round(((coalesce(text, '') <> '')::INT + (coalesce(lang, '') <> '')::INT + (coalesce(source, '') <> '')::INT) / 3, 2) AS completeness FROM documents")
def completeness(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", parsing.completeness("text", "lang", "source").alias("completeness"))


@query(f"SELECT p_partkey, p_size % 3 = 0 OR p_size % 5 = 0 AS honors, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN {CODE} || ' (Honors)' ELSE {CODE} END AS shown FROM part")
def honors_flag(spark, sf_dir):
    code, title = F.concat(_code(), F.when(F.col("p_size") % 3 == 0, "H").otherwise("")), F.concat("p_name", F.when(F.col("p_size") % 5 == 0, " honors").otherwise(""))
    rows = _part(spark, sf_dir).select("p_partkey", _code().alias("code"), codes.is_honors(code, title).alias("honors"))
    return rows.select("p_partkey", "honors", F.concat("code", F.when(F.col("honors"), " (Honors)").otherwise("")).alias("shown"))


@query(
    """SELECT s_suppkey, concat_ws(' ', 'Professor ' || s_name || ' teaches in the D' || s_nationkey || ' department', CASE WHEN s_suppkey % 50 > 0 THEN 'has an average rating of ' || format('{:.1f}', (s_suppkey % 50) / 10) || '/5.0' END,
  CASE WHEN s_suppkey % 30 > 0 THEN 'with a difficulty level of ' || format('{:.1f}', (s_suppkey % 30) / 10) || '/5.0' END, CASE WHEN s_suppkey % 7 > 0 THEN 'based on ' || (s_suppkey % 7) || ' student reviews' END,
  CASE WHEN s_suppkey % 4 > 0 THEN 'and ' || format('{:.1f}', (s_suppkey % 4 - 1) * 10.5) || '% of students would take their class again' END) || '.' AS described FROM supplier"""
)
def describe_rating(spark, sf_dir):
    k = F.col("s_suppkey")
    text = parsing.describe_rating(F.col("s_name"), F.concat(F.lit("D"), F.col("s_nationkey").cast("string")), k % 50 / 10, k % 30 / 10, k % 7, F.when(k % 4 > 0, (k % 4 - 1) * F.lit(10.5)))
    return S.read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("described"))


@query(
    """SELECT p_partkey, list_extract(['CSE: ' || n || ' B.S.', n || ' of B.A. (Secondary Education)', 'COGS: ' || n || ' (Specialization in Fine ' || n || ')', n || ' and ' || n || ' (Minor)', n || ' B.S. (Concentration in ' || n || ')'], p_partkey % 5 + 1) AS name
FROM (SELECT p_partkey, upper(p_type[1]) || lower(p_type[2:]) AS n FROM part)"""
)
def slug_to_name(spark, sf_dir):
    t = F.lower("p_type")
    said = _pick("p_partkey", F.concat(F.lit("cse_"), t, F.lit("_bs")), F.concat(t, F.lit("_of_ba_secondary_education")), F.concat(F.lit("cogs_"), t, F.lit("_with_a_specialization_in_fine_"), t), F.concat(t, F.lit("_and_"), t, F.lit("_minor")), F.concat(t, F.lit("_bs_with_concentration_in_"), t))
    return _part(spark, sf_dir).select("p_partkey", parsing.name_of_slug(said).alias("name"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '8 weeks, Jan 5 to Mar 2' END AS duration, list_extract(['On Ground/Hybrid', 'Hybrid', 'Online', 'Hybrid', 'On Ground'], (event_id % 5 + 1)::INT) AS modality FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_type = 'view'"""
)
def note_facts(spark, sf_dir):
    said = _pick("event_id", "This section meets for 8 weeks, Jan 5 to Mar 2, and its modality is On \n Ground/Hybrid. Bring a book.".replace(" \n ", " "), "Section is a hybrid class.", "Section IS AN online class.", "It is taught on campus and online.", "It will be taught in person.")
    notes = F.when(F.col("event_type") == "view", "Bring a book.").otherwise(said)
    return S.read(spark, sf_dir, "events").select("event_id", parsing.note_facts(notes).alias("n")).select("event_id", "n.duration", "n.modality")


@query(f"SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN 'TH ART ' || p_size END AS same_as, p_name || '.' AS description FROM part")
def same_as(spark, sf_dir):
    said = F.concat(F.col("p_name"), F.lit(". "), _code(), _pick("p_size", " is the same course as TH ART ", " is the same as TH ART ", ""), F.when(F.col("p_size") % 3 < 2, F.concat(F.col("p_size").cast("string"), F.lit("."))).otherwise(""))
    said = F.when(F.col("p_size") % 3 < 2, said).otherwise(F.concat("p_name", F.lit(".")))
    return _part(spark, sf_dir).select("p_partkey", parsing.same_course(said).alias("s")).select("p_partkey", "s.same_as", "s.description")


@query("SELECT event_id, list_extract([NULL, NULL, 'address or years', 'address or years', 'no schedule'], (event_id % 5 + 1)::INT) AS reject_reason FROM events")
def section_line_check(spark, sf_dir):
    rest = _pick("event_id", "9:30a.m.-10:50a.m. TTh HSS 103", "Arrange-3 Hours ONLINE", "Stewart Street", "to 2024 catalog", "see the catalog")
    number = F.lpad((F.col("event_id") % 9000 + 1000).cast("string"), 4, "0")
    return S.read(spark, sf_dir, "events").select("event_id", parsing.section_line(number, rest).alias("reject_reason"))


@query("""SELECT p_partkey, l AS letter, 'Group ' || l || CASE p_partkey % 3 WHEN 0 THEN ': all required' WHEN 1 THEN ': select ' || n || CASE n WHEN 1 THEN ' course' ELSE ' courses' END ELSE ': choose one section' END AS title
FROM (SELECT p_partkey, p_size % 3 + 1 AS n, CASE WHEN p_size % 2 = 0 THEN 'X' ELSE chr(65 + p_size % 26) END AS l FROM part)""")
def group_title(spark, sf_dir):
    letter = parsing.section_letter(F.when(F.col("p_size") % 2 == 0, " X ").otherwise(""), F.col("p_size") % 26)
    rows = _part(spark, sf_dir).select("p_partkey", letter.alias("letter"), "p_size")
    return rows.select("p_partkey", "letter", parsing.group_title(_pick("p_partkey", "all_required", "select_n_courses", "choose_one_section"), F.col("p_size") % 3 + 1, F.col("letter")).alias("title"))


@query(f"SELECT p_partkey, nullif(concat_ws('; ', CASE WHEN p_size % 2 = 0 THEN p_name END, CASE WHEN p_size % 3 = 0 THEN p_brand END, CASE WHEN p_size % 5 = 0 THEN 'Same as ' || {CODE} END), '') AS notes FROM part")
def notes_text(spark, sf_dir):
    size = F.col("p_size")
    return _part(spark, sf_dir).select("p_partkey", parsing.notes_text(F.when(size % 2 == 0, F.col("p_name")), F.when(size % 3 == 0, F.col("p_brand")).otherwise(" "), F.when(size % 5 == 0, F.concat(F.lit("Same as "), _code()))).alias("notes"))


@query(
    f"""WITH c AS (SELECT p_partkey, {CODE} AS code FROM part), s AS (
SELECT p_partkey, (p_partkey % 3 = 1)::INT AS s, unnest([[code, p_type || ' 7'], [code], ['PROMO 1'], [code, 'PROMO 2']]) AS l, unnest(range(4)) AS i FROM c JOIN part USING (p_partkey))
SELECT p_partkey, (CASE WHEN i = 1 THEN 0 ELSE i - 2 END)::INT AS edge, array_to_string(list_sort(list_distinct(l)), ' AND ') AS needs FROM s WHERE (p_partkey % 3 = 0 AND i = 1) OR (p_partkey % 3 = 1 AND i > 1)
UNION ALL SELECT p_partkey, 0, array_to_string(list_sort(list_distinct(l)), ' AND ') FROM s WHERE p_partkey % 3 = 2 AND i = 0"""
)
def prereq_edges(spark, sf_dir):
    said = _pick("p_partkey", F.concat(_code(), F.lit(" (or consent of the department)")), F.concat(F.lit("Promo 1 / "), _code(), F.lit(" and Promo 2 or eligibility")), F.concat(_code(), F.lit(" and "), F.col("p_type"), F.lit(" 7")))
    rows = _part(spark, sf_dir).select("p_partkey", F.posexplode(parsing.prerequisite_segments(said)).alias("edge", "codes"))
    return rows.select("p_partkey", "edge", F.array_join("codes", " AND ").alias("needs"))


_ASIDE = "(?:" + "|".join(parsing.ASIDES) + ")"
_FREE = lambda t: f"regexp_replace({t}, '(?i)\\([^()]*{_ASIDE}[^()]*\\)', '', 'g')"
#: One level of innermost brackets: asides go, and what they stood in if it is one; the others get other marks.
_LEVEL = lambda t: f"regexp_replace({_FREE(_FREE(t))}, '\\(([^()]*)\\)', chr(2) || '\\1' || chr(3), 'g')"


@query(
    rf"""WITH t AS (SELECT p_partkey, ['prerequisite', 'corequisite', 'advisory'][(p_partkey % 3 + 1)::INT] AS kind, replace(replace({hard_lines.REQUIREMENTS}[(p_partkey % {len(hard_lines.REQUIREMENTS)})::INT + 1], '@', p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1)), '%', p_type) AS text FROM part),
b AS (SELECT p_partkey, kind, translate({_LEVEL(_LEVEL(_LEVEL("text")))}, chr(2) || chr(3), '()') AS text FROM t),
c AS (SELECT p_partkey, kind, text, i, substr(text, i, 1) AS ch, sum(CASE substr(text, i, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS depth FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM b)),
m AS (SELECT *, depth = 0 AND (ch = '/' OR (lower(substr(text, i, 2)) = 'or' AND NOT regexp_matches(substr(' ' || text, i, 1), '\p{{L}}') AND NOT regexp_matches(substr(text || ' ', i + 2, 1), '\p{{L}}'))) AS splits FROM c),
n AS (SELECT *, count_if(splits) OVER (PARTITION BY p_partkey ORDER BY i) AS seg, coalesce(lag(splits AND ch <> '/') OVER (PARTITION BY p_partkey ORDER BY i), false) AS second FROM m),
s AS (SELECT p_partkey, kind, seg, upper(regexp_replace(string_agg(CASE WHEN splits OR second THEN '' ELSE ch END, '' ORDER BY i), '(?i)\band\b|,|;', ' ', 'g')) AS text FROM n GROUP BY ALL),
e AS (SELECT p_partkey, kind, seg, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Z]{{2,}}\s*\d+[A-Z]?'), lambda x: regexp_replace(x, '^([A-Z]+)\s*(\d+)([A-Z]?)$', '\1 \2\3')))) AS l FROM s)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY seg) - 1)::INT AS edge, kind, array_to_string(l, ' AND ') AS needs FROM e WHERE len(l) > 0"""
)
def requirement_edges(spark, sf_dir):
    """Edges of requirement texts with nested brackets, alternatives within and outside them, and asides at any depth."""
    rows = hard_lines.requirement_texts(spark, sf_dir)
    each = rows.select("p_partkey", F.posexplode(parsing.requirement_edges(F.col("text"), F.col("kind"))).alias("edge", "x"))
    return each.select("p_partkey", "edge", "x.kind", F.array_join("x.courses", " AND ").alias("needs"))
