"""The engine's operators as queries over the benchmark tables, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, text, times
from ..operators import academics, graph, intervals, labels, lines, requirements, search
from ..sources import stand_ins as S
from ..sources.files import new_folder, saved
from ..streaming import tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COURSE = r"""course AS (SELECT p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) AS code, min(p_name) AS title, (1 + min(p_size) % 5)::INT AS units,
  regexp_extract(p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1), '([0-9]+)$', 1)::INT AS number FROM part GROUP BY 1, 4)"""
TAKEN = r"""taken AS (SELECT student, code, list_extract(['A+','A-','B+','B','B-','C+','C','C-','D','F','P'], round(d * 100)::INT + 1) AS grade FROM (
  SELECT o_custkey AS student, p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) AS code, arg_min(l_discount, l_orderkey * 10000 + l_linenumber * 100 + round(l_discount * 100)) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""
OPTION = """opt AS (SELECT r::INT AS requirement, o::INT AS option, k::INT AS slot, code FROM range(60) a(r), range(3) b(o), range(2) c(k)
  JOIN (SELECT code, row_number() OVER (ORDER BY code) - 1 AS place FROM course) ON place = (r * 7 + o * 31 + k * 53) % 150)"""
PROGRESS = """prog AS (SELECT student, m.requirement, m.option, matched, required FROM
  (SELECT student, requirement, option, count(*) AS matched FROM (SELECT DISTINCT requirement, option, code FROM opt) JOIN taken USING (code) GROUP BY ALL) m
  JOIN (SELECT requirement, option, count(DISTINCT code) AS required FROM opt GROUP BY ALL) s ON m.requirement = s.requirement AND m.option = s.option)"""
DONE = "done AS (SELECT student, requirement, min(option) AS option FROM prog WHERE matched = required GROUP BY ALL)"
TARGETS = "targets AS (SELECT c_custkey AS student, r::INT AS requirement FROM customer, range(60) t(r) WHERE r % 6 = c_custkey % 6)"
AREAS = "areas AS (SELECT code, number % 7 AS area, number % 5 <> 0 AS active FROM course UNION ALL SELECT code, (number + 3) % 7, number % 5 <> 0 FROM course WHERE number % 2 = 0)"
BASE = f"WITH {COURSE}, {TAKEN}, {OPTION}, {PROGRESS}, {DONE}, {TARGETS}, {AREAS} "


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten requirements for each student."""
    students = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"))
    return students.select("student", F.explode(F.filter(F.sequence(F.lit(0), F.lit(59)), lambda r: r % 6 == F.col("student") % 6)).alias("requirement"))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options go to the students' courses: a fixed number of rows, and courses would be few keys."""
    return F.broadcast(S.option_courses(spark, sf_dir))


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements.option_progress(_options(spark, sf_dir), S.student_courses(spark, sf_dir))


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.courses(spark, sf_dir)
    first = c.select("code", (F.col("number") % 7).alias("area"), (F.col("number") % 5 != 0).alias("active"))
    return first.unionAll(c.where("number % 2 = 0").select("code", ((F.col("number") + 3) % 7).alias("area"), (F.col("number") % 5 != 0).alias("active")))


# Requirements


@query(BASE + "SELECT * FROM done")
def req_satisfied(spark, sf_dir):
    return requirements.satisfied(_progress(spark, sf_dir))


@query(BASE + "SELECT student, requirement FROM targets ANTI JOIN done USING (student, requirement)")
def req_missing(spark, sf_dir):
    return requirements.missing(targets(spark, sf_dir), requirements.satisfied(_progress(spark, sf_dir)))


@query(
    BASE
    + """, best AS (SELECT student, requirement, option, round(matched * 100.0 / required, 2)::DOUBLE AS percent FROM prog ANTI JOIN done USING (student, requirement)
  QUALIFY row_number() OVER (PARTITION BY student, requirement ORDER BY matched * 1.0 / required DESC, option) = 1)
SELECT b.student, b.requirement, b.option, b.percent, string_agg(DISTINCT o.code, ', ' ORDER BY o.code) AS lacking
FROM best b JOIN opt o ON b.requirement = o.requirement AND b.option = o.option ANTI JOIN taken t ON t.student = b.student AND t.code = o.code GROUP BY ALL"""
)
def req_partial_best(spark, sf_dir):
    taken, options = S.student_courses(spark, sf_dir), _options(spark, sf_dir)
    return requirements.best_partial(requirements.option_progress(options, taken), options, taken)


@query(
    BASE
    + """, mem AS (SELECT r::INT AS requirement, (r % 6)::INT AS grp, (r % 2 + (r // 6) % 2)::INT AS section, list_extract(['all_required','select_n_courses','choose_one_section'], (r % 3 + 1)::INT) AS logic FROM range(60) t(r)),
sec AS (SELECT student, grp, section, count(*) AS met FROM done JOIN mem USING (requirement) GROUP BY ALL),
siz AS (SELECT grp, section, count(*) AS size FROM mem GROUP BY ALL),
tot AS (SELECT grp, count(*) AS total, min(logic) AS logic FROM mem GROUP BY ALL),
per AS (SELECT student, grp, sum(met) AS met, count_if(met = size) AS complete FROM sec JOIN siz USING (grp, section) GROUP BY ALL)
SELECT student, grp, logic, CASE logic WHEN 'all_required' THEN met = total WHEN 'select_n_courses' THEN met >= 2 ELSE complete = 1 END AS satisfied FROM per JOIN tot USING (grp)"""
)
def group_satisfied(spark, sf_dir):
    r = F.col("id").cast("int")
    logic = F.element_at(F.array(*map(F.lit, ("all_required", "select_n_courses", "choose_one_section"))), r % 3 + 1)
    members = spark.range(S.REQUIREMENTS).select(r.alias("requirement"), (r % 6).alias("grp"), (r % 2 + F.floor(r / 6) % 2).cast("int").alias("section"), logic.alias("logic"), F.lit(2).alias("n"))
    return requirements.group_status(requirements.satisfied(_progress(spark, sf_dir)), members)


@query(BASE + "SELECT student, code, count(DISTINCT d.requirement) AS uses FROM done d JOIN opt o ON d.requirement = o.requirement AND d.option = o.option GROUP BY ALL HAVING uses > 1")
def reused_courses(spark, sf_dir):
    return requirements.reused_courses(requirements.satisfied(_progress(spark, sf_dir)), S.option_courses(spark, sf_dir))


@query(BASE + "SELECT requirement, bool_and(h) AS honors_required FROM (SELECT requirement, option, bool_or(number % 3 = 0) AS h FROM opt JOIN course USING (code) GROUP BY ALL) GROUP BY 1")
def honors_required(spark, sf_dir):
    flags = S.courses(spark, sf_dir).select("code", (F.col("number") % 3 == 0).alias("honors"))
    return requirements.honors_required(S.option_courses(spark, sf_dir).join(flags, "code"))


@query(
    BASE
    + """, per AS (SELECT requirement, option, count(*) AS n, string_agg(DISTINCT code, ' AND ' ORDER BY code) AS t FROM opt GROUP BY ALL)
SELECT requirement, count(*) AS options, count_if(n > 1)::BIGINT AS multi_course_options, min(n) AS fewest, max(n) AS most, string_agg(t, ' OR ' ORDER BY option) AS options_text FROM per GROUP BY 1"""
)
def logic_summary(spark, sf_dir):
    return requirements.logic_summary(S.option_courses(spark, sf_dir))


@query(
    BASE
    + """, o2 AS (SELECT * FROM opt WHERE option < 2 OR slot = 0), s AS (SELECT requirement, option, count(*) AS n FROM o2 GROUP BY ALL), j AS (SELECT code, requirement, n FROM o2 JOIN s USING (requirement, option))
SELECT c.code, coalesce(d.direct, '') AS direct, coalesce(k.contributing, '') AS contributing FROM (SELECT DISTINCT code FROM j) c
LEFT JOIN (SELECT code, string_agg(DISTINCT requirement::VARCHAR, ',' ORDER BY requirement::INT) AS direct FROM (SELECT DISTINCT code, requirement FROM j WHERE n = 1) GROUP BY 1) d USING (code)
LEFT JOIN (SELECT code, string_agg(requirement::VARCHAR, ',' ORDER BY requirement) AS contributing FROM (SELECT DISTINCT code, requirement FROM j WHERE n > 1 EXCEPT SELECT code, requirement FROM j WHERE n = 1) GROUP BY 1) k USING (code)""".replace(
        "string_agg(DISTINCT requirement::VARCHAR, ',' ORDER BY requirement::INT)", "string_agg(requirement::VARCHAR, ',' ORDER BY requirement)"
    )
)
def reverse_match(spark, sf_dir):
    return requirements.reverse_match(S.option_courses(spark, sf_dir).where("option < 2 or slot = 0"))


@query(
    BASE
    + """, t AS (SELECT DISTINCT requirement, string_agg(DISTINCT code, ' + ' ORDER BY code) AS option_text FROM opt GROUP BY requirement, option),
p AS (SELECT r::INT AS left_req, ((r + 30) % 60)::INT AS right_req FROM range(60) x(r)),
l AS (SELECT left_req, right_req, option_text FROM p JOIN t ON left_req = requirement), r AS (SELECT left_req, right_req, option_text FROM p JOIN t ON right_req = requirement)
SELECT left_req, right_req, option_text, CASE WHEN max(s) = min(s) AND max(s) = 1 THEN 'left' WHEN max(s) = min(s) THEN 'right' ELSE 'both' END AS side
FROM (SELECT *, 1 AS s FROM l UNION ALL SELECT *, 2 FROM r) GROUP BY ALL"""
)
def compare_two(spark, sf_dir):
    r = F.col("id").cast("int")
    return requirements.compare_options(S.option_courses(spark, sf_dir), spark.range(S.REQUIREMENTS).select(r.alias("left_req"), ((r + 30) % 60).alias("right_req")))


@query(
    BASE
    + """, best AS (SELECT student, requirement, max(round(matched * 100.0 / required, 2))::DOUBLE AS percent FROM prog GROUP BY ALL),
j AS (SELECT student, requirement, coalesce(percent, 0.0) AS percent FROM targets LEFT JOIN best USING (student, requirement))
SELECT student, requirement, percent, CASE WHEN percent = 100 THEN 'satisfied' WHEN percent > 0 THEN 'partial' ELSE 'missing' END AS status, bool_and(percent = 100) OVER (PARTITION BY student) AS all_satisfied FROM j"""
)
def transfer_audit(spark, sf_dir):
    return requirements.audit(targets(spark, sf_dir), _progress(spark, sf_dir))


# Academics and coverage


@query(BASE + "SELECT student, coalesce(sum(units), 0)::BIGINT AS units, count(units) AS courses, count_if(units IS NULL)::BIGINT AS unresolved FROM taken LEFT JOIN (SELECT code, units FROM course WHERE number <> 7) USING (code) GROUP BY 1")
def unit_total(spark, sf_dir):
    return academics.unit_totals(S.student_courses(spark, sf_dir), S.courses(spark, sf_dir).where("number <> 7"))


@query(BASE + "SELECT student, code, units FROM taken JOIN course USING (code)")
def unit_breakdown(spark, sf_dir):
    return S.student_courses(spark, sf_dir).join(S.courses(spark, sf_dir), "code").select("student", "code", "units")


@query(
    BASE
    + """, pts(grade, points) AS (VALUES ('A+',4.0),('A',4.0),('A-',3.7),('B+',3.3),('B',3.0),('B-',2.7),('C+',2.3),('C',2.0),('C-',1.7),('D',1.0),('F',0.0)),
s AS (SELECT student, sum(points::DOUBLE * units) AS p, sum(units) AS u FROM taken JOIN pts USING (grade) JOIN course USING (code) GROUP BY 1),
pr AS (SELECT c_custkey AS student, (c_custkey % 41) / 10.0 AS gpa, (c_custkey % 60)::INT AS units FROM customer)
SELECT student, coalesce(u, 0)::BIGINT AS graded_units, CASE WHEN u > 0 THEN floor(round((gpa::DOUBLE * units + p) / (units + u), 6) * 100 + 1e-9) / 100 ELSE gpa::DOUBLE END AS gpa FROM pr LEFT JOIN s USING (student)"""
)
def gpa_projection(spark, sf_dir):
    key = F.col("c_custkey")
    prior = S.read(spark, sf_dir, "customer").select(key.alias("student"), (key % 41 / 10.0).alias("gpa"), (key % 60).cast("int").alias("units"))
    return academics.projected_gpa(S.student_courses(spark, sf_dir), S.courses(spark, sf_dir), prior)


@query(BASE + "SELECT student, area, string_agg(DISTINCT code, ', ' ORDER BY code) AS courses FROM taken JOIN areas USING (code) WHERE active GROUP BY ALL")
def breadth_matched(spark, sf_dir):
    return academics.breadth_matched(S.student_courses(spark, sf_dir), _areas(spark, sf_dir))


@query(BASE + "SELECT student, area FROM (SELECT c_custkey AS student, area FROM customer, (SELECT DISTINCT area FROM areas WHERE active)) ANTI JOIN (SELECT student, area FROM taken JOIN areas USING (code) WHERE active) USING (student, area)")
def breadth_missing(spark, sf_dir):
    areas = _areas(spark, sf_dir)
    students = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student"))
    return academics.breadth_missing(students, academics.breadth_matched(S.student_courses(spark, sf_dir), areas), areas)


@query(BASE + "SELECT student, code FROM taken ANTI JOIN (SELECT code FROM areas WHERE active) USING (code)")
def breadth_unmatched(spark, sf_dir):
    return academics.breadth_unmatched(S.student_courses(spark, sf_dir), _areas(spark, sf_dir))


@query(
    BASE
    + """SELECT area, grouping(area)::INT AS level, count(*) AS n, count_if(active)::BIGINT AS n_active, count_if(NOT active)::BIGINT AS n_removed, min(units) AS least, max(units) AS most, round(avg(units), 2) AS mean
FROM areas JOIN course USING (code) GROUP BY ROLLUP (area)"""
)
def ge_rollup(spark, sf_dir):
    return academics.area_rollup(_areas(spark, sf_dir), S.courses(spark, sf_dir))


@query("SELECT department, code, year, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY year DESC, code) AS rank FROM (SELECT o_orderpriority AS department, o_orderkey AS code, year(o_orderdate)::INT AS year FROM orders)) WHERE rank <= 5")
def recent_courses(spark, sf_dir):
    return academics.recent_courses(S.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("department"), F.col("o_orderkey").alias("code"), F.year("o_orderdate").alias("year")))


# Intervals

MEETING = "m AS (SELECT user_id AS owner, event_id AS section, (event_id % 7)::INT AS day, hour(ts) * 60 + minute(ts) AS begins, hour(ts) * 60 + minute(ts) + 30 + event_id % 90 AS ends FROM events)"


@query(f"WITH {MEETING} SELECT a.owner, a.section AS first, b.section AS second, a.day FROM m a JOIN m b ON a.owner = b.owner AND a.day = b.day AND a.section < b.section AND a.begins < b.ends AND b.begins < a.ends")
def schedule_conflicts(spark, sf_dir):
    return intervals.schedule_conflicts(S.meetings(spark, sf_dir))


WINDOWS = "q AS (SELECT DISTINCT c_custkey * 37 % 900 AS query, DATE '1995-01-01' + (c_custkey * 37 % 900)::INT AS first_day, DATE '1995-01-01' + (c_custkey * 37 % 900)::INT + 3 AS last_day FROM customer)"


@query(f"WITH e AS (SELECT o_orderkey AS event, o_orderdate::DATE AS starts, o_orderdate::DATE + (o_orderkey % 30)::INT AS ends FROM orders), {WINDOWS} SELECT query, event FROM q JOIN e ON starts <= last_day AND ends >= first_day")
def date_overlap(spark, sf_dir):
    number = F.col("c_custkey") * 37 % 900
    day = F.date_add(F.lit("1995-01-01").cast("date"), number.cast("int"))
    asked = S.read(spark, sf_dir, "customer").select(number.alias("query"), day.alias("first_day"), F.date_add(day, 3).alias("last_day")).distinct()
    return intervals.date_overlaps(S.deadlines(spark, sf_dir), asked)


@query("SELECT o_custkey AS owner, o_orderkey AS event, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderpriority, o_orderkey)::INT AS place FROM orders")
def deadline_order(spark, sf_dir):
    orders = S.read(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"), "o_orderpriority", "o_orderkey"))
    return orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("event"), place.alias("place"))


# Text functions


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(u, '^([A-Z]{1,12})\s*(\d{1,4})([A-Z]?)$') THEN regexp_replace(u, '^([A-Z]{1,12})\s*(\d{1,4})([A-Z]?)$', '\1 \2\3') END AS code FROM (SELECT p_partkey, upper(trim(p_type || regexp_extract(p_brand, '(\d+)', 1) || CASE WHEN p_size % 3 = 0 THEN 'h' ELSE '' END)) AS u FROM part)")
def norm_code_strict(spark, sf_dir):
    raw = F.concat("p_type", F.regexp_extract("p_brand", r"(\d+)", 1), F.when(F.col("p_size") % 3 == 0, "h").otherwise(""))
    return S.read(spark, sf_dir, "part").select("p_partkey", codes.course_code(raw).alias("code"))


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(u, '^([A-Z]{2,8})(\d+)([A-Z]{0,2})$') THEN regexp_replace(u, '^([A-Z]{2,8})(\d+)([A-Z]{0,2})$', '\1 \2\3') END AS code FROM (SELECT p_partkey, regexp_replace(upper(trim(p_type || '-' || p_brand)), '[^A-Z0-9]', '', 'g') AS u FROM part)")
def norm_code_compact(spark, sf_dir):
    return S.read(spark, sf_dir, "part").select("p_partkey", codes.course_code(F.concat_ws("-", "p_type", "p_brand"), "compact").alias("code"))


_SAID = r"'take ' || lower(p_type) || '  ' || p_size || 'a, then X' || p_type || regexp_extract(p_brand, '(\d+)', 1) || ' & ' || p_name"


def _said() -> Column:
    """A text with course codes of several forms."""
    return F.concat(F.lit("take "), F.lower("p_type"), F.lit("  "), F.col("p_size").cast("string"), F.lit("a, then X"), "p_type", F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(" & "), "p_name")


@query(rf"SELECT p_partkey, nullif(regexp_extract(upper(t), '([A-Z]{{2,4}}\s*\d+[A-Z]?)', 1), '') AS code FROM (SELECT p_partkey, {_SAID} AS t FROM part)")
def norm_code_search(spark, sf_dir):
    """The first code anywhere in a text."""
    return S.read(spark, sf_dir, "part").select("p_partkey", codes.course_code(_said(), "search").alias("code"))


@query(rf"SELECT p_partkey, trim(regexp_replace(upper(t), '\s+', ' ', 'g')) AS code FROM (SELECT p_partkey, '  ' || {_SAID} || chr(9) AS t FROM part)")
def norm_code_spaced(spark, sf_dir):
    return S.read(spark, sf_dir, "part").select("p_partkey", codes.course_code(F.concat(F.lit("  "), _said(), F.lit("\t")), "spaced").alias("code"))


@query(rf"SELECT p_partkey, i::INT AS place, l[i + 1] AS code FROM (SELECT p_partkey, regexp_extract_all(regexp_replace(upper({_SAID}), '\s+', '', 'g'), '[A-Z]{{2,4}}\d+[A-Z]?') AS l FROM part), LATERAL (SELECT unnest(range(len(l))) AS i)")
def norm_code_all(spark, sf_dir):
    """Every code of a text, found without its spaces."""
    return S.read(spark, sf_dir, "part").select("p_partkey", F.posexplode(codes.all_codes(_said())).alias("place", "code"))


@query("SELECT s_suppkey, lower(list_last(string_split(trim(n), ' '))) || '|' || lower(substr(trim(n), 1, 1)) AS key FROM (SELECT s_suppkey, list_extract(['Ann Maria ', ' Bob ', 'Cy de la '], s_suppkey % 3 + 1) || s_name AS n FROM supplier)")
def name_key(spark, sf_dir):
    """Last name and first initial of full names."""
    n = F.concat(F.element_at(F.array(F.lit("Ann Maria "), F.lit(" Bob "), F.lit("Cy de la ")), (F.col("s_suppkey") % 3).cast("int") + 1), F.col("s_name"))
    return S.read(spark, sf_dir, "supplier").select("s_suppkey", codes.name_key(n).alias("key"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ') B.S. ' || p_brand), '\([^)]*\)|\b[bm]\.?[as]\.?\b', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug(spark, sf_dir):
    name = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") B.S. "), "p_brand")
    return S.read(spark, sf_dir, "part").select("p_partkey", codes.slug(name).alias("slug"))


@query(r"SELECT event_id, try_cast(nullif(regexp_extract(props, '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE) AS units FROM events")
def parse_units(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("event_id", codes.first_number(F.col("props")).alias("units"))


@query("SELECT doc_id, substr(md5(text), 1, 8) AS hash_id FROM documents")
def hash_id(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", codes.short_hash(F.col("text")).alias("hash_id"))


@query(
    """SELECT event_id, list_aggregate(list_sort(list_distinct(list_transform(regexp_extract_all(d, '(Th|Sa|Su|M|T|W|F|S|U)', 1), lambda x: CASE x WHEN 'M' THEN 1 WHEN 'T' THEN 2 WHEN 'W' THEN 3 WHEN 'Th' THEN 4 WHEN 'F' THEN 5 WHEN 'S' THEN 6 WHEN 'Sa' THEN 6 ELSE 7 END))), 'string_agg', ',') AS days
FROM (SELECT event_id, list_extract(['MW','TTh','MWF','Sa','MTWThF'], (event_id % 5 + 1)::INT) AS d FROM events)"""
)
def parse_days(spark, sf_dir):
    d = F.element_at(F.array(*map(F.lit, ("MW", "TTh", "MWF", "Sa", "MTWThF"))), (F.col("event_id") % 5 + 1).cast("int"))
    return S.read(spark, sf_dir, "events").select("event_id", F.array_join(times.meeting_days(d).cast("array<string>"), ",").alias("days"))


@query(
    """SELECT event_id, (hour(ts) * 60 + minute(ts))::INT AS begins, ((hour(ts) * 60 + minute(ts) + 50) % 1440)::INT AS ends,
  CASE WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 17 THEN 'afternoon' ELSE 'evening' END AS bucket FROM events"""
)
def parse_time_range(spark, sf_dir):
    clock = lambda t: F.lower(F.date_format(t, "h:mm a"))
    said = F.concat(clock(F.col("ts")), F.lit(" – "), clock(F.col("ts") + F.expr("interval 50 minutes")))
    rows = S.read(spark, sf_dir, "events").select("event_id", times.time_range(said).alias("r"))
    return rows.select("event_id", "r.begins", "r.ends", times.time_bucket(F.col("r.begins")).alias("bucket"))


@query(
    """SELECT o_orderkey, (y * 100 + m)::INT AS term_order, y * 100 + m > 199606 AS future FROM (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN month(o_orderdate) = 12 THEN 12 WHEN month(o_orderdate) < 6 THEN 1 WHEN month(o_orderdate) < 8 THEN 6 ELSE 8 END AS m FROM orders)"""
)
def term_status(spark, sf_dir):
    month = F.month("o_orderdate")
    season = F.when(month == 12, "W").when(month < 6, "S").when(month < 8, "Su").otherwise("F")
    term = F.concat(season, F.year("o_orderdate").cast("string"))
    return S.read(spark, sf_dir, "orders").select("o_orderkey", times.term_order(term).alias("term_order"), times.is_future_term(term, 1996, 6).alias("future"))


_quoted = lambda words: ", ".join(f"'{w}'" for w in words)


@query(
    rf"""SELECT doc_id, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 15), ' ') AS keywords FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '\b([a-z0-9-]+)\b', 1),
  lambda x: x IN ({_quoted(text.IMPORTANT)}) OR (length(x) > 3 AND x NOT IN ({_quoted(text.STOP_WORDS)}))) AS w FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', ' ', 'g') AS text FROM documents))"""
)
def keywords(spark, sf_dir):
    """Words of the texts' ASCII characters; where a word ends beside other letters is no matter of these rules."""
    plain = F.regexp_replace("text", "[^ -~]", " ")
    return S.read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keywords(plain), " ").alias("keywords"))


def _category_case() -> str:
    parts = []
    for who, rules in text.CATEGORIES.items():
        whens = " ".join(f"WHEN {' OR '.join(f'contains(low, {_quoted([w])})' for w in words)} THEN '{category}'" for category, words in rules[:-1])
        parts.append(f"WHEN '{who}' THEN CASE {whens} ELSE '{rules[-1][0]}' END")
    return f"CASE audience {' '.join(parts)} ELSE 'General' END"


@query(f"SELECT doc_id, {_category_case()} AS category FROM (SELECT doc_id, lower(text) AS low, CASE lang WHEN 'en' THEN 'student' WHEN 'de' THEN 'international' ELSE 'other' END AS audience FROM documents)")
def rule_category(spark, sf_dir):
    audience = F.when(F.col("lang") == "en", "student").when(F.col("lang") == "de", "international").otherwise("other")
    return S.read(spark, sf_dir, "documents").select("doc_id", text.rule_category(F.col("text"), audience).alias("category"))


@query(
    r"""SELECT page_id, place::INT AS place, CASE WHEN regexp_matches(link, '^(https?://|mailto:|tel:)') THEN link WHEN starts_with(link, '/') THEN base || link ELSE base || '/' || link END AS link
FROM (SELECT page_id, base, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS place FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"]*)"', 1) AS l FROM pages))"""
)
def html_links(spark, sf_dir):
    base = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    rows = S.read(spark, sf_dir, "pages").select("page_id", base.alias("base"), F.posexplode(text.links(F.col("html"))).alias("place", "link"))
    return rows.select("page_id", "place", text.absolute(F.col("link"), F.col("base")).alias("link"))


@query(
    r"""SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '&amp;', '&', 'g'), '\s+', ' ', 'g')) AS body FROM pages"""
)
def html_to_text(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), text.html_text(F.col("html")).alias("body"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm FROM pages")
def url_params(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"), F.try_parse_url("url", F.lit("QUERY"), F.lit("utm_source")).alias("utm"))


@query("SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)")
def line_scan(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def json_unpack(spark, sf_dir):
    return S.read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT lang, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.5), 4)::DOUBLE AS median, round(stddev_pop(n_chars), 4) AS sd FROM documents GROUP BY 1")
def length_stats(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.percentile("n_chars", 0.5), 4).alias("median"), F.round(F.stddev_pop("n_chars"), 4).alias("sd"))


@query(r"SELECT regexp_extract(text, '^\s*(\S+)', 1) AS word, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def starter_words(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").groupBy(F.regexp_extract("text", r"^\s*(\S+)", 1).alias("word")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(20)


# Search

TERMS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL) GROUP BY 1")
def term_stats(spark, sf_dir):
    return search.term_stats(S.read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    f"""WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) AS term FROM benchmark),
p AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, mean FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), st),
s AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 4) AS score FROM p JOIN f USING (term) JOIN q USING (term) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 10"""
)
def bm25_topk(spark, sf_dir):
    asked = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(S.read(spark, sf_dir, "documents").select("doc_id", "text"), asked)


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (
SELECT query_id, vec_id, round(list_dot_product(q, embedding::DOUBLE[]) / sqrt(list_dot_product(q, q) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS score FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
)
def knn_exact(spark, sf_dir):
    vectors = S.read(spark, sf_dir, "embeddings")
    return search.nearest(vectors, vectors.where("vec_id % 50 = 0"))


# Graphs

EDGE = "e AS (SELECT DISTINCT p_partkey AS course, n AS needs FROM part, LATERAL (SELECT unnest([p_partkey // 2, p_partkey // 3]) AS n) WHERE n >= 1 AND n < p_partkey)"


@query(f"WITH RECURSIVE {EDGE}, r(root, reached) AS (SELECT course, needs FROM e UNION SELECT root, needs FROM r JOIN e ON reached = course) SELECT root, reached FROM r")
def prereq_closure(spark, sf_dir):
    return graph.closure(S.prerequisite_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGE}, l(course, d) AS (SELECT p_partkey, 0 FROM part UNION SELECT e.course, d + 1 FROM l JOIN e ON l.course = e.needs) SELECT course, max(d)::INT AS level FROM l GROUP BY 1")
def dag_levels(spark, sf_dir):
    return graph.levels(S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("course")), S.prerequisite_edges(spark, sf_dir))


# Labels

LABELLED = "lab AS (SELECT doc_id AS id, quality::VARCHAR || toxic::VARCHAR AS label FROM labels)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label"))


@query(f"WITH {LABELLED}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY 1) SELECT label, n, round(1 / sqrt(n) / (SELECT avg(1 / sqrt(n)) FROM c), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return labels.class_weights(_labelled(spark, sf_dir))


@query(f"WITH {LABELLED} SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR), id) <= floor(count(*) OVER (PARTITION BY label) * 0.15::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM lab")
def stratified_split(spark, sf_dir):
    return labels.stratified_split(_labelled(spark, sf_dir))


@query(
    f"""WITH {LABELLED}, f AS (SELECT *, CASE label WHEN '01' THEN 4 WHEN '11' THEN 2 ELSE 1 END AS times, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY id) AS place FROM lab),
c AS (SELECT id, label, unnest(range(times + CASE WHEN n * times < 50 THEN (50 - n * times) // n + (place <= (50 - n * times) % n)::INT ELSE 0 END))::INT AS copy FROM f) SELECT id, label, copy FROM c"""
)
def oversample(spark, sf_dir):
    return labels.oversample(_labelled(spark, sf_dir), {"01": 4, "11": 2}, 50)


@query(
    rf"""WITH {LABELLED}, t AS (SELECT id, label, text, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR), id) <= floor(count(*) OVER (PARTITION BY label) * 0.15::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM lab JOIN documents ON doc_id = id),
f AS (SELECT *, CASE label WHEN '01' THEN 4 WHEN '11' THEN 2 ELSE 1 END AS times, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY id) AS place FROM t WHERE part = 'train'),
c AS (SELECT id, label, text, unnest(range(times + CASE WHEN n * times < 50 THEN (50 - n * times) // n + (place <= (50 - n * times) % n)::INT ELSE 0 END))::INT AS copy FROM f),
k AS (SELECT *, ('0x' || substr(md5(id || ':' || copy), 1, 2))::INT % 3 AS kind FROM c)
SELECT id, label, CASE WHEN copy = 0 THEN text WHEN kind = 0 THEN lower(text) WHEN kind = 1 THEN regexp_replace(text, '[.!?]\z', '') ELSE regexp_replace(text, '(?s).\z', 'x') END AS text, copy, 'train' AS part FROM k
UNION ALL SELECT id, label, text, 0, part FROM t WHERE part <> 'train'"""
)
def augmented_split(spark, sf_dir):
    """Labelled texts, split, and those to train on oversampled with changed copies."""
    texts = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return labels.augmented_split(_labelled(spark, sf_dir).join(texts, "id"), {"01": 4, "11": 2}, 50)


@query(f"WITH {LABELLED} SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS idx FROM (SELECT DISTINCT label FROM lab)")
def label_index(spark, sf_dir):
    return labels.label_index(_labelled(spark, sf_dir))


@query(
    """WITH j AS (SELECT quality AS truth, (doc_id % 3 > 0)::INT AS pred FROM labels), x AS (SELECT truth AS label, 1 AS t, 0 AS p, 0 AS h FROM j UNION ALL SELECT pred, 0, 1, (truth = pred)::INT FROM j),
s AS (SELECT label, sum(t)::BIGINT AS support, sum(p) AS said, sum(h) AS hits FROM x GROUP BY 1)
SELECT label, round(coalesce(hits / nullif(said, 0), 0), 4)::DOUBLE AS precision, round(coalesce(hits / nullif(support, 0), 0), 4)::DOUBLE AS recall, round(coalesce(2 * hits / nullif(said + support, 0), 0), 4)::DOUBLE AS f1, support FROM s"""
)
def classification_report(spark, sf_dir):
    return labels.classification_report(S.read(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), (F.col("doc_id") % 3 > 0).cast("int").alias("pred")))


# Quality


@query("SELECT lang, count(*) AS n, count_if(text IS NULL OR trim(text) = '')::BIGINT AS empty, count_if(n_chars < 20)::BIGINT AS short, count_if(regexp_matches(text, '^[a-z]'))::BIGINT AS lower_start, count_if(NOT regexp_matches(text, '[.!?]\\s*$'))::BIGINT AS open_end FROM documents GROUP BY 1".replace("\\\\", "\\"))
def completeness_counts(spark, sf_dir):
    t = F.col("text")
    return S.read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(t.isNull() | (F.trim(t) == "")).alias("empty"), F.count_if(F.col("n_chars") < 20).alias("short"), F.count_if(t.rlike("^[a-z]")).alias("lower_start"), F.count_if(~t.rlike(r"[.!?]\s*\z")).alias("open_end"))


@query(
    r"""SELECT p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) AS code, count(DISTINCT p_partkey // 50) AS files, count(DISTINCT p_name) AS titles, count(DISTINCT p_size) AS notes, min(p_name) AS first_title FROM part GROUP BY 1 HAVING files > 1 AND (titles > 1 OR notes > 1)"""
)
def title_conflicts(spark, sf_dir):
    """Codes that several files have with other titles or notes."""
    code = F.concat_ws(" ", "p_type", F.regexp_extract("p_brand", r"(\d+)", 1))
    rows = S.read(spark, sf_dir, "part").select(code.alias("code"), F.floor(F.col("p_partkey") / 50).alias("file"), F.col("p_name").alias("title"), F.col("p_size").alias("note"))
    per = rows.groupBy("code").agg(F.count_distinct("file").alias("files"), F.count_distinct("title").alias("titles"), F.count_distinct("note").alias("notes"), F.min("title").alias("first_title"))
    return per.where("files > 1 and (titles > 1 or notes > 1)")


@query("SELECT doc_id, 'unlabelled' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'unknown' FROM labels ANTI JOIN documents USING (doc_id)")
def reconcile(spark, sf_dir):
    d, lab = S.read(spark, sf_dir, "documents").select("doc_id"), S.read(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_anti").withColumn("side", F.lit("unlabelled")).unionAll(lab.join(d, "doc_id", "left_anti").withColumn("side", F.lit("unknown")))


# Tasks


def _events(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "ts", F.col("user_id").alias("plan"), F.col("event_type").alias("tool"), F.when(F.col("event_id") % 2 == 0, "finished").otherwise("started").alias("state"))


FINISHED = "SELECT user_id AS plan, event_type AS tool, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL"


@query(FINISHED)
def merge_results(spark, sf_dir):
    return tasks.finished_by_tool(_events(spark, S.read(spark, sf_dir, "events")))


PLANNED = """WITH p AS (SELECT user_id AS plan, count(DISTINCT event_type) AS planned FROM events GROUP BY 1), d AS (SELECT user_id AS plan, count(DISTINCT event_type) AS done FROM events WHERE event_id % 2 = 0 GROUP BY 1)
SELECT plan, planned, coalesce(done, 0) AS done, round(coalesce(done, 0) / planned, 4) AS coverage, round(coalesce(done, 0) / planned, 4) < 0.6 AS needs_more FROM p LEFT JOIN d USING (plan)"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(S.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return _events(spark, source.withColumn("ts", F.col("ts").cast("timestamp")))


@query(PLANNED)
def stream_coverage(spark, sf_dir):
    """Coverage from a stream over the table's file, run until all that is there is read."""
    events = S.read(spark, sf_dir, "events")
    finished = tasks.latest(tasks.run_updates(tasks.finished_by_tool(_stream(spark, sf_dir)), new_folder(spark, "coverage")), "plan", "tool")
    return tasks.plan_coverage(events.select(F.col("user_id").alias("plan"), F.col("event_type").alias("tool")), finished)


@query(
    """WITH e AS (SELECT user_id AS plan, event_id, ts::TIMESTAMP AS ts, event_type AS tool FROM events WHERE event_id % 2 = 0), n AS (SELECT user_id AS plan, count(DISTINCT event_type) AS planned FROM events GROUP BY 1),
d AS (SELECT *, count(DISTINCT tool) OVER (PARTITION BY plan ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM e)
SELECT plan, event_id, ts, tool, done, planned, round(done / planned, 4) AS coverage FROM d JOIN n USING (plan)"""
)
def stream_coverage_updates(spark, sf_dir):
    """Coverage after each finished event, from a stream with a state for each plan."""
    planned = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("plan"), F.col("event_type").alias("tool"))
    return tasks.run_updates(tasks.coverage_updates(_stream(spark, sf_dir), planned), new_folder(spark, "updates")).drop("batch")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, CASE WHEN event_id % 2 = 0 THEN 'finished' ELSE 'started' END AS state, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Windows of a stream over the table's file; what the watermark has not closed is given as it stands."""
    return tasks.latest(tasks.run_updates(tasks.windowed_counts(_stream(spark, sf_dir)), new_folder(spark, "windows")), "window_start", "state")


@query(PLANNED)
def plan_coverage(spark, sf_dir):
    e = _events(spark, S.read(spark, sf_dir, "events"))
    return tasks.plan_coverage(e.select("plan", "tool"), e.where("state = 'finished'").select("plan", "tool"))


# Lines

LINES = "ln AS (SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"WITH {LINES} SELECT doc_id, line_no, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS owner FROM ln")
def segment_lines(spark, sf_dir):
    return lines.fill_owner(_lines(spark, sf_dir), F.length("line") < 40).select("doc_id", "line_no", "owner")


@query(
    f"""WITH {LINES}, f AS (SELECT *, CASE WHEN regexp_matches(line, '^[a-z]') AND NOT regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '[.:]$') THEN 0 ELSE 1 END AS new FROM ln),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM f) SELECT doc_id, min(line_no) AS first_line, count(*) AS n, string_agg(line, ' ' ORDER BY line_no) AS text FROM r GROUP BY doc_id, run"""
)
def merge_lines(spark, sf_dir):
    return lines.merge_lines(_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id, line_no FROM ln QUALIFY length(line) < 40 AND bool_or(contains(line, 'tion')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)")
def header_lookahead(spark, sf_dir):
    return lines.confirmed_headers(_lines(spark, sf_dir), F.length("line") < 40, F.contains("line", F.lit("tion")))


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(spark, sf_dir):
    return lines.first_of_each(S.read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def category_counts(spark, sf_dir):
    return S.read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT key, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 4)::DOUBLE AS percent FROM (SELECT unnest(json_keys(props::JSON)) AS key FROM events) GROUP BY 1")
def key_frequency(spark, sf_dir):
    events = S.read(spark, sf_dir, "events")
    whole = events.agg(F.count("*").alias("whole"))
    keys = events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return keys.join(F.broadcast(whole)).select("key", "n", F.round(F.col("n") * 100.0 / F.col("whole"), 4).alias("percent"))


LOGITS = "lg AS (SELECT doc_id AS id, l AS label, ((doc_id * k * 31) % 17) / 4.0::DOUBLE AS logit FROM labels, (VALUES ('a', 1), ('b', 3), ('c', 7)) v(l, k))"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.lit(k).alias("k")) for label, k in (("a", 1), ("b", 3), ("c", 7)))))
    return S.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), kinds.alias("x")).select("id", "x.label", (F.col("id") * F.col("x.k") * 31 % 17 / 4.0).alias("logit"))


@query(
    f"""WITH {LOGITS}, p AS (SELECT id, label, exp(logit - max(logit) OVER w) AS w0 FROM lg WINDOW w AS (PARTITION BY id)), s AS (SELECT id, label, w0 / sum(w0) OVER (PARTITION BY id) AS p FROM p)
SELECT id, CASE WHEN p >= 0.6 THEN label ELSE 'other' END AS label, round(p, 6) AS p FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, label) = 1"""
)
def softmax_threshold(spark, sf_dir):
    return labels.thresholded(_logits(spark, sf_dir), 0.6, "other")


@query(
    f"""WITH {LOGITS}, t AS (SELECT doc_id AS id, list_extract(['a','b','c'], (doc_id % 3 + 1)::INT) AS truth FROM labels), g(t) AS (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0), (8.0)),
o AS (SELECT lg.id, max(CASE WHEN label = truth THEN logit END) AS own FROM lg JOIN t ON lg.id = t.id GROUP BY 1), n AS (SELECT o.id, g.t, ln(sum(exp((logit - own) / g.t))) AS nll FROM o JOIN lg ON o.id = lg.id, g GROUP BY ALL)
SELECT t AS temperature, round(avg(nll), 6) AS nll FROM n GROUP BY 1 ORDER BY 2, 1 LIMIT 1"""
)
def temperature_fit(spark, sf_dir):
    truth = S.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("doc_id") % 3 + 1).cast("int")).alias("truth"))
    return labels.temperature_fit(_logits(spark, sf_dir), truth, [0.5, 1.0, 2.0, 4.0, 8.0])
