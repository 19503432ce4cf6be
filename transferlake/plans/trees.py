"""Agreements from JSON text as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trees
from ..sources import agreements, files
from ..sources import stand_ins as S
from .queries import query

#: The cells of the agreements and their groups, straight from the tables; rank is the group's number in its agreement.
CELLS = """WITH cell0 AS (SELECT l_orderkey AS agreement, l_linenumber AS pos, min(l_partkey) AS part, min(l_suppkey) AS supp, max(l_quantity)::INT AS qty FROM lineitem GROUP BY ALL),
cell AS (SELECT c.*, p_type AS prefix, regexp_extract(p_brand, '([0-9]+)', 1) AS number, p_name AS title, CASE WHEN p_size % 7 > 0 THEN (p_size % 5 + 1)::DOUBLE END AS units, (pos - 1) // 4 AS grp, (pos - 1) % 2 AS sec, agreement || '-' || pos AS id
  FROM cell0 c JOIN part ON part = p_partkey JOIN orders ON o_orderkey = agreement),
g0 AS (SELECT agreement, grp, any_value(o_orderpriority) AS name, count(*) FILTER (sec = 1) AS n_b, count(*) FILTER (sec = 0 AND pos % 6 <> 5) AS a_courses FROM cell JOIN orders ON agreement = o_orderkey GROUP BY ALL),
g1 AS (SELECT *, row_number() OVER (PARTITION BY agreement ORDER BY grp)::INT AS group_id, CASE WHEN agreement % 2 = 0 OR n_b > 0 THEN 2 ELSE 1 END AS n_sections,
  CASE WHEN (agreement + grp) % 3 > 0 THEN CASE WHEN agreement % 4 = 0 THEN 'RECOMMENDED ' ELSE '' END || name || ' prep' END AS own_title FROM g0),
grps AS (SELECT *, coalesce(last_value(own_title IGNORE NULLS) OVER (PARTITION BY agreement ORDER BY grp ROWS UNBOUNDED PRECEDING), '') AS area, own_title IS NOT NULL AND agreement % 4 = 0 AS recommended,
  CASE WHEN agreement % 7 = 0 THEN 1 WHEN n_sections = 1 AND agreement % 5 = 0 AND a_courses >= 2 THEN 2 WHEN (agreement + grp) % 6 = 1 THEN 2 WHEN (agreement + grp) % 6 = 2 AND n_sections = 1 THEN 1 END AS n,
  CASE WHEN (agreement + grp) % 6 = 5 OR ((agreement + grp) % 6 = 2 AND n_sections > 1) THEN 'choose_one_section' ELSE 'all_required' END AS base FROM g1),
gr AS (SELECT *, CASE WHEN n IS NOT NULL THEN 'select_n_courses' ELSE base END AS group_logic FROM grps),
full_ AS (SELECT c.*, group_id, area, recommended, name, group_logic, n AS group_n, chr((65 + sec)::INT) AS section,
  CASE WHEN supp % 4 = 0 THEN 'Note ' || supp ELSE '' END AS note, CASE WHEN pos % 5 <> 0 AND qty % 3 = 0 THEN 'Sent ' || qty ELSE '' END AS sending_note,
  CASE WHEN pos % 6 = 5 THEN prefix || ' ' || number || ' + ' || prefix || ' ' || number || 'B' ELSE prefix || ' ' || number END AS course,
  CASE WHEN pos % 5 = 0 OR pos % 7 = 0 THEN []::VARCHAR[][] ELSE list_concat([CASE WHEN qty % 2 = 0 THEN ['SUP ' || supp, 'SUP ' || (supp + 1)] ELSE ['SUP ' || supp] END], CASE WHEN pos % 3 = 0 THEN [['ALT ' || part]] ELSE []::VARCHAR[][] END) END AS options,
  CASE WHEN (agreement + sec) % 5 = 0 THEN 'select_n_courses' ELSE 'all_required' END AS own_logic, CASE WHEN (agreement + sec) % 5 = 0 THEN 2 END AS own_n
  FROM cell c JOIN gr USING (agreement, grp))
"""
_TEXT = """prefix || ' ' || number || ': ' || title || CASE WHEN units IS NOT NULL THEN printf(' (%.2f units)', units) ELSE '' END"""


@query(
    CELLS
    + f"""SELECT agreement, area, group_id, section, id AS cell_id, CASE WHEN note <> '' THEN note || chr(10) ELSE '' END || {_TEXT} || CASE WHEN pos % 6 = 5 THEN ' AND ' || prefix || ' ' || number || 'B: ' || title || ' (2.00 units)' ELSE '' END AS receiving_text,
  CASE WHEN len(options) > 0 THEN array_to_string(list_transform(options, lambda o: CASE WHEN len(o) > 1 THEN '(' || array_to_string(o, ' AND ') || ')' ELSE o[1] END), ' OR ') WHEN pos % 5 <> 0 THEN 'No Comparable Course' ELSE 'No Course Articulated' END AS sending_text FROM full_"""
)
def agreement_flatten(spark, sf_dir):
    return trees.flatten(agreements.raw_agreements(spark, sf_dir))


@query(
    CELLS
    + """, sec AS (SELECT g.*, unnest(range(n_sections)) AS s FROM gr g), ser AS (SELECT DISTINCT a.agreement, a.grp, a.sec AS s FROM cell a JOIN cell b ON a.agreement = b.agreement AND a.grp = b.grp AND a.sec = b.sec AND a.pos % 6 = 5 AND b.pos % 6 <> 5 AND a.prefix = b.prefix AND (a.number = b.number OR a.number || 'B' = b.number))
SELECT agreement, group_id, chr((65 + s)::INT) AS section, group_logic, n AS group_n, CASE WHEN (agreement + s) % 5 = 0 OR ser.s IS NOT NULL THEN 'select_n_courses' ELSE 'all_required' END AS section_logic, CASE WHEN (agreement + s) % 5 = 0 THEN 2 WHEN ser.s IS NOT NULL THEN 1 END AS section_n
FROM sec LEFT JOIN ser USING (agreement, grp, s)"""
)
def infer_logic(spark, sf_dir):
    return trees.logic(agreements.raw_agreements(spark, sf_dir))


@query(
    CELLS
    + """, ser AS (SELECT DISTINCT a.agreement, a.grp, a.sec FROM cell a JOIN cell b ON a.agreement = b.agreement AND a.grp = b.grp AND a.sec = b.sec AND a.pos % 6 = 5 AND b.pos % 6 <> 5 AND a.prefix = b.prefix AND (a.number = b.number OR a.number || 'B' = b.number))
SELECT f.agreement, group_id, CASE WHEN area <> '' THEN area WHEN group_logic = 'choose_one_section' THEN 'Choose one section' WHEN group_logic = 'select_n_courses' THEN 'Select ' || group_n ELSE 'All required' END AS group_title, group_logic AS group_logic_type, group_n AS n_courses, recommended, section AS section_id,
  CASE WHEN group_logic = 'select_n_courses' OR own_n IS NOT NULL OR ser.sec IS NOT NULL THEN 'select_n_courses' ELSE 'all_required' END AS section_logic_type, CASE WHEN group_logic = 'select_n_courses' THEN group_n WHEN own_n IS NOT NULL THEN own_n WHEN ser.sec IS NOT NULL THEN 1 END AS section_n,
  course AS uc_course_id, title AS uc_course_title, coalesce(units, 4) + CASE WHEN pos % 6 = 5 THEN 2 ELSE 0 END AS units, units IS NULL AS units_estimated FROM full_ f LEFT JOIN ser ON ser.agreement = f.agreement AND ser.grp = f.grp AND ser.sec = f.sec"""
)
def requirement_tree(spark, sf_dir):
    """The trees, a row for each requirement."""
    return trees.requirements_of(trees.trees(agreements.raw_agreements(spark, sf_dir))).drop("name", "note", "sending_note", "options")


@query(
    CELLS
    + """SELECT agreement, group_id, section AS section_id, course AS uc_course, len(options) = 0 AS no_articulation, coalesce(list_max(list_transform(options, lambda o: len(o))), 0)::INT AS course_count, coalesce(list_bool_or(list_transform(options, lambda o: len(o) > 1)), false) AS multi_course_option,
  CASE WHEN len(options) = 0 THEN 'No articulated course.' ELSE array_to_string(list_transform(options, lambda o, i: 'Option ' || chr((64 + i)::INT) || ': ' || array_to_string(o, ' + ')), '; ') END AS options_summary,
  array_to_string(list_sort(list_distinct(flatten(options))), ', ') AS ccc_courses,
  course || ' - ' || title || chr(10) || 'Group: ' || group_id || ' | Section: ' || section || chr(10) || 'Logic Type: ' || group_logic || ' | N Required: ' || coalesce(group_n::VARCHAR, 'N/A') AS text FROM full_"""
)
def flatten_docs(spark, sf_dir):
    return trees.documents(trees.trees(agreements.raw_agreements(spark, sf_dir)))


@query(
    CELLS
    + """, ln AS (SELECT agreement, group_id, section, 'Section ' || section || ': ' || string_agg(course || ' <- ' || CASE WHEN len(options) = 0 THEN 'No Course Articulated' ELSE array_to_string(list_transform(options, lambda o: array_to_string(o, ' + ')), ' or ') END, '; ' ORDER BY pos) AS line, flatten(list(flatten(options))) AS sent FROM full_ GROUP BY ALL)
SELECT agreement, group_id, string_agg(line, chr(10) ORDER BY section) AS summary, array_to_string(list_sort(list_distinct(flatten(list(sent)))), ', ') AS courses FROM ln GROUP BY ALL""".replace("FROM full_ GROUP BY ALL)", "FROM full_ GROUP BY agreement, group_id, section)").replace("FROM ln GROUP BY ALL", "FROM ln GROUP BY agreement, group_id")
)
def group_summary(spark, sf_dir):
    return trees.group_summary(trees.trees(agreements.raw_agreements(spark, sf_dir)))


@query(CELLS + "SELECT agreement, side, group_id, section AS section_id, course AS uc_course, CASE side WHEN 'receiving' THEN note ELSE sending_note END AS note FROM full_, (VALUES ('receiving'), ('sending')) v(side) WHERE CASE side WHEN 'receiving' THEN note ELSE sending_note END <> ''")
def notes_extract(spark, sf_dir):
    return trees.notes_extract(trees.trees(agreements.raw_agreements(spark, sf_dir)))


@query(
    CELLS
    + """, x AS (SELECT agreement, dense_rank() OVER (PARTITION BY agreement, group_id ORDER BY section) AS s, row_number() OVER (PARTITION BY agreement, group_id, section ORDER BY pos) AS c, group_id, part, qty, pos FROM full_)
SELECT agreement, 'agreement' AS place, 'missing major' AS issue FROM (SELECT DISTINCT agreement FROM x) WHERE agreement % 11 = 0
UNION ALL SELECT DISTINCT agreement, 'G' || group_id, 'missing group title' FROM x WHERE (agreement + group_id) % 5 = 0
UNION ALL SELECT DISTINCT agreement, 'G' || group_id || '.S' || s, 'missing section logic type' FROM x WHERE (agreement + s) % 13 = 0
UNION ALL SELECT agreement, 'G' || group_id || '.S' || s || '.C' || c, CASE WHEN part % 17 = 0 THEN 'missing logic block' ELSE 'unknown logic type' END FROM x WHERE part % 17 = 0 OR part % 17 = 5"""
)
def agreement_conformance(spark, sf_dir):
    """Trees as JSON text with faults by their numbers, as a converter would leave them."""
    return trees.conformance(_faulty(spark, sf_dir))


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = agreements.cells(spark, sf_dir).withColumn("grp", F.floor((F.col("pos") - 1) / 4)).withColumn("section_id", trees.letter((F.col("pos") - 1) % 2))
    kind = F.when(F.col("part") % 17 == 5, "XOR").otherwise("OR")
    block = F.when(F.col("part") % 17 != 0, F.struct(kind.alias("type"), F.array(F.col("supp").cast("string")).alias("courses")))
    course = F.struct("pos", F.struct(F.concat_ws(" ", "prefix", "number").alias("uc_course_id"), F.col("title").alias("uc_course_title"), block.alias("logic_block")).alias("v"))
    section = cells.groupBy("agreement", "grp", "section_id").agg(F.transform(F.array_sort(F.collect_list(course)), lambda x: x["v"]).alias("uc_courses"))
    listed = section.groupBy("agreement", "grp").agg(F.array_sort(F.collect_list(F.struct("section_id", "uc_courses"))).alias("s"))
    sections = F.transform("s", lambda x, i: F.struct(x["section_id"].alias("section_id"), F.when((F.col("agreement") + i + 1) % 13 != 0, "all_required").alias("section_logic_type"), x["uc_courses"].alias("uc_courses")))
    per = listed.groupBy("agreement").agg(F.array_sort(F.collect_list(F.struct("grp", sections.alias("sections")))).alias("g"))
    groups = F.transform("g", lambda x, i: F.struct((i + 1).alias("group_id"), F.when((F.col("agreement") + i + 1) % 5 != 0, "title").alias("group_title"), x["sections"].alias("sections")))
    return per.select("agreement", F.to_json(F.struct(F.when(F.col("agreement") % 11 != 0, "m").alias("major"), groups.alias("groups"))).alias("tree"))


@query("SELECT p_type AS program, count(*) AS courses, min(p_name) AS first_title, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def json_scan(spark, sf_dir):
    """Program files, written as indented JSON and read back; each holds the courses of a block of parts."""
    part = S.read(spark, sf_dir, "part")
    blocks = part.groupBy("p_type", F.floor(F.col("p_partkey") / 5000).alias("block")).agg(F.collect_list(F.struct(F.col("p_name").alias("course_title"), F.col("p_size").alias("size"))).alias("courses"))  # 5,000 parts at most
    path = files.new_folder(spark, "programs")
    body = F.to_json(F.struct(F.col("p_type").alias("program_name"), "courses"), {"pretty": "true"})
    blocks.select("p_type", "block", body.alias("value")).repartition("p_type", "block").write.partitionBy("p_type", "block").text(path)
    rows = files.read_json_tree(spark, path, "program_name string, courses array<struct<course_title: string, size: int>>", "program_name")
    each = rows.select(F.col("program_name").alias("program"), F.explode("courses").alias("c"))
    return each.groupBy("program").agg(F.count("*").alias("courses"), F.min("c.course_title").alias("first_title"), F.sum("c.size").alias("size"))
