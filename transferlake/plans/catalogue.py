"""Catalogue text as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue
from ..sources import catalogues, hard_lines
from ..sources import stand_ins as S
from .queries import LINES, _lines, query

COURSES = """WITH cell AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY ALL),
c AS (SELECT cell.*, p_type AS prefix, regexp_extract(p_brand, '([0-9]+)', 1) AS number, p_name AS title, p_size AS size FROM cell JOIN part ON part = p_partkey)
"""


_EDGE = """, u{n} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) = 1 AS up, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no DESC) = 1 AS down FROM {of}),
e{n} AS (SELECT doc_id, line_no, line, page, key FROM (SELECT *, up AND count_if(up) OVER k >= 3 AS top, down AND count_if(down) OVER k >= 3 AS bottom FROM u{n} WINDOW k AS (PARTITION BY doc_id, key)) WHERE NOT top AND NOT bottom)"""
_SPLIT = " OR ".join(f"(ends_with(p, '{a}') AND starts_with(line, '{b}'))" for a, b in catalogue.SPLIT_WORDS.items())
_CLEANED = (
    r"""b AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM ln),
m AS (SELECT *, coalesce(CASE WHEN regexp_matches(line, '^\d{1,3}$') THEN line::INT BETWEEN 13 AND 103 END, false) AS ends FROM b),
k0 AS (SELECT * FROM m WHERE ends OR NOT ((length(line) <= 2 AND NOT regexp_matches(line, '^\d+$')) OR regexp_matches(line, '^[A-Z\s]{10,}$'))),
k1 AS (SELECT *, coalesce(count_if(ends) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page, regexp_replace(line, '\d+', '#', 'g') AS key FROM k0),
k2 AS (SELECT * FROM k1 WHERE NOT ends)"""
    + _EDGE.replace("{n}", "1").replace("{of}", "k2")
    + _EDGE.replace("{n}", "2").replace("{of}", "e1")
    + r""", f AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM e2),
j AS (SELECT *, coalesce(SPLIT, false) AS split, coalesce(SPLIT, false) OR coalesce(regexp_matches(line, '^\p{Ll}') AND NOT regexp_matches(p, '[.:]$') AND len(string_split(line, ' ')) < 8, false) AS joins FROM f),
r AS (SELECT *, count_if(NOT joins) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM j)
SELECT doc_id, min(line_no) AS first_line, count(*) AS n, replace(ltrim(string_agg(CASE WHEN split THEN chr(1) ELSE ' ' END || line, '' ORDER BY line_no)), '-' || chr(1), '') AS text FROM r GROUP BY doc_id, run""".replace("SPLIT", _SPLIT)
)


@query(f"WITH {LINES}, {_CLEANED}")
def clean_lines(spark, sf_dir):
    return catalogue.cleaned(_lines(spark, sf_dir))


@query(
    f"""WITH pg AS (SELECT l_suppkey AS doc_id, l_orderkey * 8 + l_linenumber AS spot, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
ln AS (SELECT doc_id, spot * 16 + i AS line_no, replace(replace({hard_lines.PAGE}[i + 1], '#', part::VARCHAR), '@', (spot % 120)::VARCHAR) AS line FROM pg, range({len(hard_lines.PAGE)}) t(i) WHERE (part + i) % 7 <> 0), {_CLEANED}"""
)
def clean_pages(spark, sf_dir):
    """Pages with running titles, footers, page numbers, captions and split words, cleaned and merged."""
    return catalogue.cleaned(hard_lines.page_lines(spark, sf_dir))


@query(
    COURSES
    + """, l AS (SELECT *, 4 + (size % 2 = 0)::INT + (size % 3 = 0)::INT + (size % 5 = 0)::INT + 2 * (size % 4 = 0)::INT + (size % 6 = 0)::INT + (size % 7 = 0)::INT - 1 AS n, pos IN (1, 5) AS opens FROM c),
s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY pos) AS segment FROM l)
SELECT doc_id, segment, max(CASE WHEN opens THEN 'Area ' || (pos // 4) END) AS title, max(CASE WHEN opens THEN prefix END) AS under, sum(n + 2 * opens::INT)::BIGINT AS n_lines FROM s WHERE segment > 0 GROUP BY ALL""".replace(", l AS (SELECT *, 4 +", ", l AS (SELECT *, 4 +")
)
def segment_programs(spark, sf_dir):
    return catalogue.segments(catalogues.catalogue_lines(spark, sf_dir))


@query(
    COURSES
    + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS course_no, prefix || ' ' || number AS code, title, (size % 5 + 1)::DOUBLE AS units, CASE WHEN size % 2 = 0 THEN 'UC, CSU' END AS transfer, CASE WHEN size % 3 = 0 THEN prefix || ' ' || number || '00.' END AS c_id,
  CASE WHEN size % 5 = 0 THEN (size % 7 + 1)::VARCHAR END AS ge_area, CASE WHEN size % 4 = 0 THEN prefix || ' 1, and consent of instructor.' END AS prerequisite, NULL::VARCHAR AS corequisite, CASE WHEN size % 6 = 0 THEN prefix || ' 2.' END AS advisory,
  CASE WHEN size % 7 = 0 THEN prefix || ' ' || number || 'A.' END AS formerly, 'Covers ' || title || ' in part ' || part || '.' AS description FROM c"""
)
def parse_course_blocks(spark, sf_dir):
    return catalogue.course_blocks(catalogues.catalogue_lines(spark, sf_dir))


_BODY = "regexp_replace(line, '" + catalogue.COMBINED + "', '')"
for _begins in catalogue.LABELS.values():
    _BODY = f"regexp_replace({_BODY}, '{_begins}', '')"
_LABEL = "CASE WHEN regexp_matches(line, '" + catalogue.COMBINED + "') THEN regexp_split_to_array(lower(regexp_extract(line, '" + catalogue.COMBINED + r"', 1)), '\s*/\s*')" + "".join(f" WHEN regexp_matches(line, '{b}') THEN ['{n}']" for n, b in catalogue.LABELS.items()) + " END"
_FIELD = lambda n: f"list_reduce(list(body ORDER BY line_no) FILTER (list_contains(fields, '{n}')), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || ' ' || x END) AS {n}"


@query(
    rf"""WITH pg AS (SELECT l_orderkey AS doc_id, l_linenumber::INT AS pos, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
ln AS (SELECT doc_id, pos * 100 + i AS line_no, replace({["MATH #, CALCULUS # 5 UNITS", *hard_lines.COURSE]}[i + 1], '#', part::VARCHAR) AS line FROM pg, range({len(hard_lines.COURSE) + 1}) t(i) WHERE i = 0 OR (part + i) % 7 <> 0),
k AS (SELECT *, regexp_matches(line, '{catalogue.HEADER}') AS header, regexp_matches(line, '^[=~]') OR regexp_matches(line, '{catalogue.SCHEDULE}') OR regexp_matches(line, '{catalogue.ARRANGED}') AS mark FROM ln),
c AS (SELECT *, count_if(header) OVER (PARTITION BY doc_id ORDER BY line_no) AS course_no, CASE WHEN NOT header AND NOT mark THEN {_LABEL} END AS labels, {_BODY} AS body FROM k),
b AS (SELECT *, header OR mark OR labels IS NOT NULL OR coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '[.]\s*$'), true) AS opens FROM c),
g AS (SELECT *, count_if(opens) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM b),
f AS (SELECT *, first_value(labels) OVER (PARTITION BY doc_id, run ORDER BY line_no) AS own FROM g),
p AS (SELECT *, CASE WHEN header OR mark THEN []::VARCHAR[] WHEN labels IS NOT NULL THEN labels WHEN own IS NOT NULL AND list_has_any(own, {catalogue.OPEN_FIELDS}) THEN own ELSE ['description'] END AS fields FROM f)
SELECT doc_id, course_no, regexp_extract(max(line) FILTER (header), '{catalogue.HEADER}', 1) || ' ' || regexp_extract(max(line) FILTER (header), '{catalogue.HEADER}', 2) AS code, regexp_extract(max(line) FILTER (header), '{catalogue.HEADER}', 3) AS title, regexp_extract(max(line) FILTER (header), '{catalogue.HEADER}', 4)::DOUBLE AS units,
  {', '.join(_FIELD(n) for n in [*catalogue.LABELS, 'description'])} FROM p WHERE course_no > 0 GROUP BY doc_id, course_no"""
)
def parse_hard_courses(spark, sf_dir):
    """Courses whose fields repeat, go on over many lines or are combined, read from the lines."""
    return catalogue.courses_in(hard_lines.course_texts(spark, sf_dir))


@query(
    COURSES
    + """SELECT doc_id, CASE WHEN pos % 2 = 0 THEN (1 + supp % 9) || ':00a.m.-' || (1 + supp % 9) || ':50p.m.' ELSE 'Arrange-' || pos || ' Hours' END AS time, CASE WHEN pos % 2 = 0 THEN list_extract(['MW', 'TTh', 'MWF'], (supp % 3 + 1)::INT) ELSE 'N' END AS days,
  CASE WHEN pos % 2 = 0 THEN 'BUS ' || (100 + pos) WHEN supp % 2 = 0 THEN 'TBA' ELSE 'ONLINE' END AS location, CASE WHEN pos % 2 = 0 THEN 'Smith J' WHEN supp % 2 = 0 THEN 'Staff' ELSE 'Jones Ann' END AS instructor FROM c"""
)
def parse_schedule_line(spark, sf_dir):
    return catalogue.schedules(catalogues.catalogue_lines(spark, sf_dir)).drop("line_no")


@query(
    """WITH p AS (SELECT *, (2000 + p_size % 20)::VARCHAR AS y, p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) AS code FROM part)
SELECT p_partkey // 100 AS doc_id, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS course_no, code, p_name AS title, (p_size % 5 + 1)::DOUBLE AS units,
  CASE WHEN p_size % 2 = 0 THEN '3A F' || y || ', 4 F' || y ELSE '5B F' || y END || CASE WHEN p_size % 4 = 0 THEN ', 4B S' || y ELSE '' END AS areas, 'F' || y AS approved, CASE WHEN p_size % 3 = 0 THEN 'Su' || y END AS removed,
  p_size % 3 <> 0 OR (2000 + p_size % 20) * 100 + 6 > 201006 AS active, CASE WHEN p_size % 5 = 0 THEN 'Same as: ' || p_type || ' 9' ELSE '' END AS notes FROM p"""
)
def parse_ge_lines(spark, sf_dir):
    return catalogue.education_courses(catalogues.education_lines(spark, sf_dir), 2010, 6)


@query(
    COURSES
    + """, t AS (SELECT l_orderkey AS doc_id, string_agg(p_name, ' ') AS text FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10 AND l_orderkey % 9 > 0 GROUP BY 1)
SELECT doc_id, prefix || ' ' || number AS code, 'repeated code' AS issue FROM c GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, prefix || ' ' || number, 'title not in source' FROM c JOIN t USING (doc_id) WHERE NOT contains(lower(text), lower(title))
UNION ALL SELECT DISTINCT doc_id, prefix || ' ' || number, 'no source' FROM c ANTI JOIN t USING (doc_id)"""
)
def reference_check(spark, sf_dir):
    rows = catalogue.course_headers(catalogues.catalogue_lines(spark, sf_dir)).select("doc_id", "code", "title")
    lines = S.read(spark, sf_dir, "lineitem").where("l_quantity > 10 and l_orderkey % 9 > 0").select(F.col("l_orderkey").alias("doc_id"), "l_partkey")
    names = lines.join(S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return catalogue.reference_check(rows, names.groupBy("doc_id").agg(F.array_join(F.collect_list("p_name"), " ").alias("text")))


_W = r"[\p{L}\p{N}_]"
_DECIDED = f"""CASE WHEN length(first) > 2 AND NOT list_contains({catalogue.COMPOUNDS}, lower(first)) AND NOT (length(second) >= 4 AND regexp_matches(second, '^[aeiou]') AND NOT list_contains({catalogue.PREFIXES}, lower(first))) THEN first || second ELSE first || '-' || gap || second END"""
_MARKED = "{'first': split_part(p, chr(2), 1), 'gap': split_part(split_part(p, chr(2), 2), chr(4), 1), 'second': split_part(split_part(p, chr(4), 2), chr(3), 1), 'behind': split_part(p, chr(3), 2)}"


@query(
    rf"""WITH b AS (SELECT doc_id, {{0}} AS text FROM documents),
j AS (SELECT doc_id, regexp_replace(text, '({_W}+)-\s*\n\s*({_W}+)', '\1\2', 'g') AS text FROM b),
m AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '({_W}+)-(\s+)([a-z]{_W}+)', chr(1) || '\1' || chr(2) || '\2' || chr(4) || '\3' || chr(3), 'g'), chr(1)), lambda p: CASE WHEN contains(p, chr(2)) THEN {_MARKED} ELSE {{{{'first': NULL, 'gap': NULL, 'second': NULL, 'behind': p}}}} END) AS l FROM j)
SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN x.first IS NULL THEN x.behind ELSE {_DECIDED.replace("first", "x.first").replace("second", "x.second").replace("gap", "x.gap")} || x.behind END), '') AS text FROM m""".replace("{0}", r"""regexp_replace(regexp_replace(text, '(\p{L})tion', '\1-' || chr(10) || 'tion', 'g'), '(\p{L}+)(en|th|in|se)(\p{L})', '\1- \2\3', 'g')""").replace("{{", "{").replace("}}", "}")
)
def fix_hyphenation(spark, sf_dir):
    """Texts whose words are broken at line ends before ``tion``, and by spaces at four other places, repaired by the rules; breaks that look like compounds or two words stay."""
    broken = F.regexp_replace(F.regexp_replace("text", r"(\p{L})tion", "$1-\ntion"), r"(\p{L}+)(en|th|in|se)(\p{L})", "$1- $2$3")
    return S.read(spark, sf_dir, "documents").select("doc_id", catalogue.without_breaks(broken).alias("text"))
