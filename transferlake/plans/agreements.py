"""Agreements, matching and comparisons as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import academics, agreements, matching, requirements
from ..sources import stand_ins as S
from .catalog import CODE, _code, _pick
from .queries import BASE, query, targets

HONORS = "honors AS (SELECT requirement, option, slot, code, number % 3 = 0 AS honors FROM opt JOIN course USING (code))"
MAJORS = "req AS (SELECT DISTINCT requirement % 12 AS major, code FROM opt WHERE option = 0)"


def _honors(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = S.courses(spark, sf_dir).select("code", (F.col("number") % 3 == 0).alias("honors"))
    return S.option_courses(spark, sf_dir).join(flags, "code")


def _majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.option_courses(spark, sf_dir).where("option = 0").select((F.col("requirement") % 12).alias("major"), "code").distinct()


# Facts about agreements


@query(BASE + "SELECT requirement, count_if(n > 1)::BIGINT AS and_blocks, (count(*) > 1)::INT AS or_blocks, sum(n)::BIGINT AS courses, (max(n) > 1)::INT + (count(*) > 1)::INT AS nesting FROM (SELECT requirement, option, count(*) AS n FROM opt GROUP BY ALL) GROUP BY 1")
def logic_stats(spark, sf_dir):
    return agreements.logic_stats(S.option_courses(spark, sf_dir))


@query(BASE + f", {MAJORS} SELECT code, string_agg(major::VARCHAR, ', ' ORDER BY major) AS majors FROM req GROUP BY 1 HAVING count(*) > 1")
def shared_courses(spark, sf_dir):
    return agreements.shared_courses(_majors(spark, sf_dir))


@query(
    BASE
    + f""", req0 AS (SELECT DISTINCT 'm' || (requirement % 12) AS major, code FROM opt WHERE option = 0), sh AS (SELECT a.major, a.code, b.major AS other FROM req0 a JOIN req0 b ON a.code = b.code AND a.major <> b.major)
SELECT major, string_agg(DISTINCT code, ', ' ORDER BY code) AS shared, string_agg(DISTINCT other, ', ' ORDER BY other) AS others FROM sh GROUP BY 1"""
)
def alternative_paths(spark, sf_dir):
    return agreements.alternative_paths(_majors(spark, sf_dir).withColumn("major", F.concat(F.lit("m"), F.col("major").cast("string"))))


@query(
    BASE
    + """, o2 AS (SELECT 'm' || (requirement % 12) AS major, 'R ' || (requirement % 4) AS receiving, CASE WHEN requirement % 11 = 0 THEN 'not articulated' ELSE 'articulated' END AS status, requirement * 3 + option AS option, code FROM opt WHERE option < 2 OR slot = 0),
per AS (SELECT major, receiving, status, option, string_agg(DISTINCT code, ' AND ' ORDER BY code) AS sending, CASE WHEN count(DISTINCT code) > 1 THEN 'AND' ELSE 'single' END AS kind FROM o2 GROUP BY ALL)
SELECT receiving, sending, status, kind, string_agg(DISTINCT major, ', ' ORDER BY major) AS majors, count(DISTINCT major) AS n_majors FROM per GROUP BY ALL"""
)
def course_mappings(spark, sf_dir):
    rows, r = S.option_courses(spark, sf_dir).where("option < 2 or slot = 0"), F.col("requirement")
    status = F.when(r % 11 == 0, "not articulated").otherwise("articulated")
    return agreements.course_mappings(rows.select(F.concat(F.lit("m"), (r % 12).cast("string")).alias("major"), F.concat(F.lit("R "), (r % 4).cast("string")).alias("receiving"), (r * 3 + F.col("option")).alias("option"), "code", status.alias("status")))


@query(
    """SELECT p_type AS grp, count(*) AS options, count_if(p_size % 4 > 0)::BIGINT AS transferable, count_if(p_size % 4 = 0)::BIGINT AS non_transferable, round(max(p_size % 5 + 1) / greatest(count_if(p_size % 4 > 0), 1), 4)::DOUBLE AS difficulty,
  CASE WHEN count_if(p_size % 4 > 0) = count(*) THEN 'transferable' WHEN count_if(p_size % 4 > 0) = 0 THEN 'non-transferable' ELSE 'mixed' END AS status FROM part GROUP BY 1"""
)
def requirement_stats(spark, sf_dir):
    rows = S.read(spark, sf_dir, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("requirement"), (F.col("p_size") % 4 > 0).alias("transferable"), (F.col("p_size") % 5 + 1).alias("needed"))
    return agreements.requirement_stats(rows)


@query(f"SELECT p_type AS department, count(DISTINCT p_brand) AS numbers, count(*) - count(DISTINCT p_brand) AS duplicates, round(avg(1 + p_size % 5), 4) AS mean_units, min(1 + p_size % 5) AS least, max(1 + p_size % 5) AS most FROM part GROUP BY 1")
def code_profile(spark, sf_dir):
    units = 1 + F.col("p_size") % 5
    numbers = F.count_distinct("p_brand")
    return S.read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("department")).agg(numbers.alias("numbers"), (F.count("*") - numbers).alias("duplicates"), F.round(F.avg(units), 4).alias("mean_units"), F.min(units).alias("least"), F.max(units).alias("most"))


@query("SELECT p_brand AS code, count(DISTINCT p_type) AS departments, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS names FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def shared_dept_codes(spark, sf_dir):
    names = F.array_sort(F.collect_set("p_type"))
    return S.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(F.size(names).cast("long").alias("departments"), F.array_join(names, ", ").alias("names")).where("departments > 1")


HCODE = f"SELECT DISTINCT o_custkey AS student, {CODE} || CASE WHEN l_quantity % 2 = 0 THEN 'H' ELSE '' END AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"


@query(f"WITH t AS ({HCODE}) SELECT a.student, a.code AS base FROM t a JOIN t b ON a.student = b.student AND b.code = a.code || 'H'")
def redundant_courses(spark, sf_dir):
    lines = S.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = S.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("student"))
    part = S.read(spark, sf_dir, "part").select("p_partkey", _code().alias("code"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(part, lines.l_partkey == part.p_partkey)
    return agreements.redundant_courses(rows.select("student", F.concat("code", F.when(F.col("l_quantity") % 2 == 0, "H").otherwise("")).alias("code")))


@query(f"SELECT code, title, side, units FROM (SELECT {CODE} AS code, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'sending' ELSE 'receiving' END AS side, 1 + p_size % 5 AS units, p_partkey FROM part) QUALIFY row_number() OVER (PARTITION BY code ORDER BY p_partkey) = 1")
def course_dictionary(spark, sf_dir):
    side = F.when(F.col("p_partkey") % 2 == 0, "sending").otherwise("receiving")
    return agreements.course_dictionary(S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), _code().alias("code"), F.col("p_name").alias("title"), side.alias("side"), (1 + F.col("p_size") % 5).alias("units")))


@query(BASE + f", {HONORS} SELECT requirement, coalesce(string_agg(DISTINCT code, ', ' ORDER BY code) FILTER (honors), '') AS honors, coalesce(string_agg(DISTINCT code, ', ' ORDER BY code) FILTER (NOT honors), '') AS plain FROM honors GROUP BY 1")
def honors_split(spark, sf_dir):
    return agreements.honors_split(_honors(spark, sf_dir))


@query(
    BASE
    + f""", {HONORS}, per AS (SELECT requirement, option, string_agg(DISTINCT code, ' + ' ORDER BY code) || ' [' || CASE WHEN count(DISTINCT code) > 1 THEN 'group' ELSE 'single' END || CASE WHEN bool_or(honors) THEN ', honors' ELSE '' END || ']' AS t FROM honors GROUP BY ALL)
SELECT requirement, string_agg(t, '; ' ORDER BY option) AS listing FROM per GROUP BY 1"""
)
def options_list(spark, sf_dir):
    return agreements.options_list(_honors(spark, sf_dir))


@query(
    BASE
    + """, o2 AS (SELECT * FROM opt WHERE requirement % 11 > 0 AND (option = 0 OR requirement % 3 > 0) AND (slot = 0 OR requirement % 4 > 0)), per AS (SELECT requirement, count(*) AS options, max(n) AS most FROM (SELECT requirement, option, count(*) AS n FROM o2 GROUP BY ALL) GROUP BY 1)
SELECT (r % 6)::INT AS grp, count(options) AS articulated, count_if(options IS NULL)::BIGINT AS not_articulated, count_if(options > 1)::BIGINT AS or_groups, count_if(most > 1)::BIGINT AS and_groups FROM range(60) t(r) LEFT JOIN per ON r = requirement GROUP BY 1"""
)
def requirement_profile(spark, sf_dir):
    r = F.col("id").cast("int")
    options = S.option_courses(spark, sf_dir).where("requirement % 11 > 0 and (option = 0 or requirement % 3 > 0) and (slot = 0 or requirement % 4 > 0)")
    return agreements.requirement_profile(options, spark.range(S.REQUIREMENTS).select(r.alias("requirement"), (r % 6).alias("grp")))


@query(BASE + "SELECT student, requirement FROM targets ANTI JOIN (SELECT requirement FROM opt WHERE requirement % 11 > 0) USING (requirement)")
def no_articulation(spark, sf_dir):
    return requirements.missing(targets(spark, sf_dir), targets(spark, sf_dir).join(S.option_courses(spark, sf_dir).where("requirement % 11 > 0").select("requirement").distinct(), "requirement").select("student", "requirement"))


@query(
    BASE
    + """, w AS (SELECT o.requirement, 0 AS grp, o.option AS alternative, code FROM opt o UNION ALL SELECT requirement, 1, slot, code FROM opt WHERE option = 0),
a AS (SELECT requirement, grp, alternative, list(DISTINCT code) AS l FROM w GROUP BY ALL), p AS (SELECT x.requirement, x.alternative * 2 + y.alternative AS option, list_sort(list_distinct(x.l || y.l)) AS l FROM a x JOIN a y ON x.requirement = y.requirement AND x.grp = 0 AND y.grp = 1)
SELECT requirement, (row_number() OVER (PARTITION BY requirement ORDER BY option) - 1)::INT AS option, array_to_string(l, ' AND ') AS courses FROM p"""
)
def logic_dnf(spark, sf_dir):
    options = S.option_courses(spark, sf_dir)
    rows = options.select("requirement", F.lit(0).alias("grp"), F.col("option").alias("alternative"), "code")
    return agreements.logic_dnf(rows.unionAll(options.where("option = 0").select("requirement", F.lit(1), "slot", "code")))


@query(
    BASE
    + """, c AS (SELECT (r % 10)::INT AS comparison, r::INT AS requirement FROM range(60) t(r) WHERE r < 30)
SELECT comparison, code, string_agg(requirement, ',' ORDER BY requirement) AS requirements, count(*) = 3 AS common FROM (SELECT DISTINCT comparison, requirement, code FROM c JOIN opt USING (requirement)) GROUP BY ALL"""
)
def compare_many(spark, sf_dir):
    r = F.col("id").cast("int")
    return agreements.compare_many(S.option_courses(spark, sf_dir), spark.range(30).select((r % 10).alias("comparison"), r.alias("requirement")))


@query(
    BASE
    + """, ch AS (SELECT DISTINCT l_orderkey AS student, p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) AS code FROM lineitem JOIN part ON l_partkey = p_partkey), se AS (SELECT DISTINCT requirement AS section, code FROM opt WHERE slot = 0 OR option = 1),
p AS (SELECT DISTINCT student, section FROM ch JOIN se USING (code)), m AS (SELECT student, list(code) AS own FROM ch GROUP BY 1), w AS (SELECT section, list(code) AS wanted FROM se GROUP BY 1),
x AS (SELECT student, section, list_sort(list_filter(wanted, lambda c: NOT list_contains(own, c))) AS lacks, list_sort(list_filter(own, lambda c: NOT list_contains(wanted, c))) AS extra FROM p JOIN m USING (student) JOIN w USING (section))
SELECT student, section, CASE WHEN len(lacks) = 0 AND len(extra) = 0 THEN 'exact' WHEN len(extra) = 0 THEN 'partial' ELSE 'over-complete' END AS kind, array_to_string(lacks, ', ') AS missing, array_to_string(extra, ', ') AS extra FROM x WHERE len(lacks) = 0 OR len(extra) = 0"""
)
def path_completion(spark, sf_dir):
    chosen = S.order_courses(spark, sf_dir)
    sections = S.option_courses(spark, sf_dir).where("slot = 0 or option = 1").select(F.col("requirement").alias("section"), "code").distinct()
    return agreements.path_completion(chosen, sections)


@query(f"SELECT p_partkey, c || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS id FROM (SELECT p_partkey, {CODE} AS c, row_number() OVER (PARTITION BY {CODE} ORDER BY p_partkey) - 1 AS n FROM part)")
def assign_ids(spark, sf_dir):
    return agreements.assign_ids(S.read(spark, sf_dir, "part").select("p_partkey", _code().alias("code")), "code", F.floor(F.col("p_partkey") / 10_000), "p_partkey").select("p_partkey", "id")


@query(
    """WITH p AS (SELECT l_orderkey AS series, sum(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END) AS a, sum(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + l_linenumber % 2 END) AS b, max(CASE WHEN l_orderkey % 2 = 0 THEN l_tax * 100 END) AS own, count(*) AS n FROM lineitem GROUP BY 1)
SELECT series, round(CASE WHEN a > 0 THEN a ELSE coalesce(own, n * 4) END, 4) AS units, round(CASE WHEN a > 0 AND b > a THEN b END, 4) AS max_units, coalesce(a, 0) = 0 AND own IS NULL AS estimated FROM p"""
)
def series_units(spark, sf_dir):
    third, q = F.col("l_linenumber") % 3 == 0, F.col("l_quantity")
    rows = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("series"), F.when(third, q).alias("least"), F.when(third, q + F.col("l_linenumber") % 2).alias("most"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_tax") * 100).alias("own"))
    return agreements.series_units(rows).select("series", F.round("units", 4).alias("units"), F.round("max_units", 4).alias("max_units"), "estimated")


@query(
    BASE
    + """, pts(grade, points) AS (VALUES ('A+',4.0),('A',4.0),('A-',3.7),('B+',3.3),('B',3.0),('B-',2.7),('C+',2.3),('C',2.0),('C-',1.7),('D',1.0),('F',0.0))
SELECT student, sum(units)::BIGINT AS units, CASE WHEN sum(units) FILTER (points IS NOT NULL) > 0 THEN floor(round(sum(points::DOUBLE * units) / sum(units) FILTER (points IS NOT NULL), 6) * 100 + 1e-9) / 100 ELSE 0.0::DOUBLE END AS gpa
FROM taken JOIN course USING (code) LEFT JOIN pts USING (grade) GROUP BY 1"""
)
def profile_recompute(spark, sf_dir):
    taken, courses = S.student_courses(spark, sf_dir), S.courses(spark, sf_dir)
    totals = academics.unit_totals(taken, courses)
    prior = totals.select("student", F.lit(0.0).alias("gpa"), F.lit(0).alias("units"))
    return totals.select("student", "units").join(academics.projected_gpa(taken, courses, prior).select("student", "gpa"), "student")


# Matching

LIST = "l AS (SELECT student, list(DISTINCT code) AS codes FROM taken GROUP BY 1)"


def _course_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.student_courses(spark, sf_dir).groupBy("student").agg(F.collect_set("code").alias("codes"))


@query(BASE + f", {LIST} SELECT student, len(codes) AS n FROM l WHERE student % 2 = 0 AND list_has_all(codes, ['ECONOMY 1', 'PROMO 2'])")
def doc_filter_all(spark, sf_dir):
    rows = matching.filter_documents(_course_lists(spark, sf_dir).withColumn("even", F.col("student") % 2), {"even": 0}, all_of=["ECONOMY 1", "PROMO 2"])
    return rows.select("student", F.size("codes").cast("long").alias("n"))


@query(BASE + f", {LIST} SELECT student, len(codes) AS n FROM l WHERE list_has_any(codes, ['ECONOMY 1', 'PROMO 2'])")
def doc_filter_any(spark, sf_dir):
    return matching.filter_documents(_course_lists(spark, sf_dir), any_of=["ECONOMY 1", "PROMO 2"]).select("student", F.size("codes").cast("long").alias("n"))


@query(
    BASE
    + """, d AS (SELECT code AS course, requirement % 20 AS grp, option AS section, min(requirement * 6 + option * 2 + slot) AS doc FROM opt GROUP BY ALL),
q AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 25 END AS grp, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 END AS section, 'ECONOMY ' || (c_custkey % 30) AS course FROM customer),
f AS (SELECT query, CASE WHEN q.section = d.section THEN 1 ELSE 2 END AS tier, doc, d.section FROM q JOIN d ON q.grp = d.grp UNION ALL SELECT query, 3, doc, d.section FROM q JOIN d USING (course)),
b AS (SELECT * FROM f QUALIFY tier = min(tier) OVER (PARTITION BY query)), g AS (SELECT *, arg_min(section, doc) OVER (PARTITION BY query) AS first FROM b)
SELECT query, tier, row_number() OVER (PARTITION BY query ORDER BY doc)::INT AS rank, doc FROM (SELECT DISTINCT query, tier, doc FROM g WHERE tier = 3 OR section = first) QUALIFY rank <= 5"""
)
def tiered_match(spark, sf_dir):
    docs = S.option_courses(spark, sf_dir).select(F.col("code").alias("course"), (F.col("requirement") % 20).alias("grp"), F.col("option").alias("section"), (F.col("requirement") * 6 + F.col("option") * 2 + F.col("slot")).alias("doc"))
    k = F.col("c_custkey")
    asked = S.read(spark, sf_dir, "customer").select(k.alias("query"), F.when(k % 3 < 2, k % 25).alias("grp"), F.when(k % 2 == 0, k % 4).alias("section"), F.concat(F.lit("ECONOMY "), (k % 30).cast("string")).alias("course"))
    return matching.tiered(asked, docs)


@query(
    f"""WITH n AS (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part), q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS query FROM part UNION SELECT DISTINCT lower(p_type || ' ' || p_brand) FROM part WHERE p_size = 1),
w AS (SELECT query, unnest(list_distinct(string_split(lower(query), ' '))) AS w, len(list_distinct(string_split(lower(query), ' '))) AS size FROM q), nw AS (SELECT name, unnest(list_distinct(string_split(lower(name), ' '))) AS w FROM n),
p AS (SELECT query, name, min(size) AS size, count(*) AS shared FROM w JOIN nw USING (w) GROUP BY ALL),
s AS (SELECT query, name, round(greatest(1 - levenshtein(lower(query), lower(name)) / greatest(length(query), length(name)), CASE WHEN contains(lower(name), lower(query)) THEN 0.8::DOUBLE ELSE 0.0 END, 0.9::DOUBLE * shared / size), 6) AS score FROM p),
o AS (SELECT *, row_number() OVER v = 1 AND score > 0.95 AND score - coalesce(lead(score) OVER v, 0) > 0.1::DOUBLE AS clear FROM s WHERE score >= 0.4 WINDOW v AS (PARTITION BY query ORDER BY score DESC, name))
SELECT query, name, score, CASE WHEN clear THEN 'accepted' ELSE 'ambiguous' END AS status FROM o QUALIFY clear OR NOT bool_or(clear) OVER (PARTITION BY query)"""
)
def fuzzy_names(spark, sf_dir):
    part = S.read(spark, sf_dir, "part")
    full = F.concat_ws(" ", "p_type", "p_brand")
    asked = part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("query")).unionAll(part.where("p_size = 1").select(F.lower(full)))
    return matching.fuzzy_names(asked, part.select(full.alias("name")))


@query(
    f"""WITH s AS (SELECT DISTINCT lower(p_type) || '-' || lower(p_brand) AS slug FROM part), q AS (SELECT DISTINCT list_extract([lower(p_type) || '-' || lower(p_brand), lower(p_brand), p_name], p_partkey % 3 + 1) AS query FROM part)
SELECT query, coalesce(e.slug, c.slug) AS slug, CASE WHEN e.slug IS NOT NULL THEN 'exact' WHEN c.slug IS NOT NULL THEN 'within' ELSE 'none' END AS level, e.slug IS NULL AND coalesce(c.n, 0) > 1 AS several
FROM q LEFT JOIN s e ON query = e.slug LEFT JOIN (SELECT query, min(slug) AS slug, count(*) AS n FROM q JOIN s ON contains(slug, query) GROUP BY 1) c USING (query)"""
)
def slug_lookup(spark, sf_dir):
    slug = F.lower(F.concat_ws("-", "p_type", "p_brand"))
    part = S.read(spark, sf_dir, "part")
    return matching.slug_lookup(part.select(_pick("p_partkey", slug, F.lower("p_brand"), F.col("p_name")).alias("query")), part.select(slug.alias("slug")))


@query(
    """WITH t AS (SELECT c_custkey AS teacher, 'name' || (c_custkey % 1000) AS last, chr((65 + c_custkey % 3)::INT) AS initial FROM customer), r AS (SELECT s_suppkey AS rating, 'Name' || (s_suppkey % 1000) AS last, chr((97 + s_suppkey % 2)::INT) AS initial FROM supplier)
SELECT teacher, rating, CASE WHEN lower(t.initial) = lower(r.initial) THEN 'exact' ELSE 'last' END AS match_level FROM t JOIN r ON lower(t.last) = lower(r.last)"""
)
def rating_link(spark, sf_dir):
    named = lambda table, key, start, first, n: S.read(spark, sf_dir, table).select(F.col(key), F.concat(F.lit(start), (F.col(key) % 1000).cast("string")).alias("last"), F.char(first + F.col(key) % n).alias("initial"))
    return matching.rating_link(named("customer", "c_custkey", "name", 65, 3).withColumnRenamed("c_custkey", "teacher"), named("supplier", "s_suppkey", "Name", 97, 2).withColumnRenamed("s_suppkey", "rating"))


ASK = "SELECT p_partkey, list_extract(['Does ' || p_type || ' 7 and 8B satisfy PROMO 3?', 'Which courses satisfy ' || p_type || ' ' || p_size || '?', 'Are ' || p_type || ' 1 and ' || p_type || ' 2 the same?', 'Does anything need honors?', p_name], p_partkey % 5 + 1) AS text FROM part"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, some = F.col("p_type"), F.lit
    text = _pick("p_partkey", F.concat(some("Does "), t, some(" 7 and 8B satisfy PROMO 3?")), F.concat(some("Which courses satisfy "), t, some(" "), F.col("p_size").cast("string"), some("?")), F.concat(some("Are "), t, some(" 1 and "), t, some(" 2 the same?")), "Does anything need honors?", F.col("p_name"))
    return S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), text.alias("text"))


MENTIONED = f"""a AS ({ASK}), m AS (SELECT p_partkey AS query, list_filter([CASE p_partkey % 5 WHEN 0 THEN p_type || ' 7' WHEN 1 THEN p_type || ' ' || p_size WHEN 2 THEN p_type || ' 1' END, CASE p_partkey % 5 WHEN 0 THEN p_type || ' 8B' WHEN 2 THEN p_type || ' 2' END, CASE p_partkey % 5 WHEN 0 THEN 'PROMO 3' END], lambda x: x IS NOT NULL) AS l FROM part)"""


@query(f"WITH {MENTIONED} SELECT query, unnest(l) AS code FROM m")
def carry_prefix(spark, sf_dir):
    return matching.mentions(_asked(spark, sf_dir)).select("query", "code")


ENDINGS = ["", " Is that one full path?", " Do they need honors courses?", " Any articulation at Foothill?", " Tell me more.", " Do both require it?", " An H version would do.", " See group 2."]


def _intent_case() -> str:
    """SQL of the rules: each is tried in its order on the lower-cased text."""
    quote = lambda x: x.replace("'", "''")
    whens = ["WHEN regexp_matches(low, 'group [0-9]') THEN 'group'"]
    for kind, (t0, t1), (o0, o1), words, patterns, besides in matching.INTENTS:
        some = [f"contains(low, '{quote(w)}')" for w in words] + [f"regexp_matches(low, '{quote(p)}')" for p in patterns]
        more = [f"regexp_matches(low, '{quote(p)}')" for p in besides]
        tests = [f"targets BETWEEN {t0} AND {t1}", f"own BETWEEN {o0} AND {o1}", *(["(" + " OR ".join(x) + ")" for x in (some, more) if x])]
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{kind}'")
    return f"CASE {' '.join(whens)} ELSE 'unknown' END"


@query(
    f"""WITH {MENTIONED}, n AS (SELECT m.query, lower(a.text || list_extract([{", ".join(f"'{e}'" for e in ENDINGS)}], m.query // 5 % 8 + 1)) AS low, len(list_filter(list_distinct(l), lambda c: NOT starts_with(c, 'PROMO'))) AS targets, len(list_filter(list_distinct(l), lambda c: starts_with(c, 'PROMO'))) AS own FROM m JOIN a ON m.query = a.p_partkey)
SELECT query, {_intent_case()} AS intent FROM n"""
)
def intent_rules(spark, sf_dir):
    asked = _asked(spark, sf_dir)
    found = matching.mentions(asked).groupBy("query").agg(F.collect_set("code").alias("codes"))
    is_own = lambda c: F.startswith(c, F.lit("PROMO"))
    count = lambda keep: F.coalesce(F.size(F.filter("codes", keep)), F.lit(0))
    rows = asked.join(found, "query", "left").select("query", "text", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
    whole = F.concat("text", F.element_at(F.array(*map(F.lit, ENDINGS)), (F.floor(F.col("query") / 5) % 8 + 1).cast("int")))
    return rows.select("query", matching.intent(whole, count(lambda c: ~is_own(c)), count(is_own), F.lower(whole).rlike("group [0-9]")).alias("intent"))


@query(f"WITH {MENTIONED}, c AS (SELECT DISTINCT {CODE} AS code FROM part) SELECT query, code, (dense_rank() OVER (PARTITION BY query ORDER BY code))::INT AS sub_query FROM (SELECT DISTINCT query, unnest(l) AS code FROM m) SEMI JOIN c USING (code)")
def mention_match(spark, sf_dir):
    known = S.courses(spark, sf_dir).select("code")
    found = matching.mentions(_asked(spark, sf_dir)).select("query", "code").distinct().join(known, "code", "left_semi")
    return found.select("query", "code", F.dense_rank().over(Window.partitionBy("query").orderBy("code")).alias("sub_query"))


@query(
    """WITH h AS (SELECT user_id AS query, event_id % 3 AS variant_no, event_id AS place, event_id % 37 AS doc FROM events), f AS (SELECT query, doc, min(variant_no * 1000000000 + place) AS a FROM h GROUP BY ALL)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY a, doc)::INT AS rank, doc, a // 1000000000 AS variant_no FROM f QUALIFY rank <= 5"""
)
def variant_union(spark, sf_dir):
    hits = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("query"), (F.col("event_id") % 3).alias("variant_no"), F.col("event_id").alias("place"), (F.col("event_id") % 37).alias("doc"))
    return matching.first_variants(hits, 5)


@query(
    """WITH e AS (SELECT user_id AS plan, event_id % 50 AS node, event_type AS tool, props AS args, event_id % 2 AS old FROM events), n AS (SELECT plan, node, tool, args FROM e WHERE old = 0), s AS (SELECT * FROM e WHERE old = 1)
SELECT plan, node, tool, args FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.plan = n.plan AND s.node = n.node) AND NOT EXISTS (SELECT 1 FROM s WHERE s.plan = n.plan AND s.tool = n.tool AND s.args = n.args)"""
)
def plan_delta(spark, sf_dir):
    rows = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("plan"), (F.col("event_id") % 50).alias("node"), F.col("event_type").alias("tool"), F.col("props").alias("args"), (F.col("event_id") % 2).alias("old"))
    return matching.new_nodes(rows.where("old = 0").drop("old"), rows.where("old = 1").drop("old"))


# Lookups and unions


@query(f"SELECT o_orderkey AS request, upper(trim(c)) AS code, p IS NOT NULL AS found, p AS title FROM (SELECT o_orderkey, ' ' || lower(list_extract(['ECONOMY', 'PROMO', 'NONE'], (o_orderkey % 3 + 1)::INT)) || ' ' || (o_orderkey % 27) AS c FROM orders) LEFT JOIN (SELECT {CODE} AS code, min(p_name) AS p FROM part GROUP BY 1) ON upper(trim(c)) = code")
def keyed_lookup(spark, sf_dir):
    asked = F.concat(_pick("o_orderkey", " economy ", " promo ", " none "), (F.col("o_orderkey") % 27).cast("string"))
    requests = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.upper(F.trim(asked)).alias("code"))
    return requests.join(S.courses(spark, sf_dir).select("code", "title"), "code", "left").select("request", "code", F.col("title").isNotNull().alias("found"), "title")


@query("SELECT o_orderkey, coalesce(n::VARCHAR || ' courses', 'No articulation') AS text FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def cell_articulation(spark, sf_dir):
    per = S.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.count("*").cast("string"), F.lit(" courses")).alias("text"))
    return S.read(spark, sf_dir, "orders").select("o_orderkey").join(per, "o_orderkey", "left").select("o_orderkey", F.coalesce("text", F.lit("No articulation")).alias("text"))


@query("SELECT doc_id AS id, text, lang, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, NULL, 'benchmark' FROM benchmark UNION ALL SELECT conv_id, text, NULL, 'conversations' FROM conversations".replace("SELECT doc_id AS id,", "SELECT doc_id AS id, NULL::BIGINT AS turn,").replace("SELECT item_id,", "SELECT item_id, NULL,").replace("SELECT conv_id,", "SELECT conv_id, turn,"))
def corpus_union(spark, sf_dir):
    docs = S.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.lit("documents").alias("origin"))
    items = S.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin"))
    turns = S.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"), "text", F.lit("conversations").alias("origin"))
    return docs.unionByName(items, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)


@query("SELECT course, needs FROM (SELECT DISTINCT p_partkey AS course, n AS needs FROM part, LATERAL (SELECT unnest([p_partkey // 2, p_partkey // 3]) AS n) WHERE n >= 1 AND n < p_partkey) ANTI JOIN (SELECT p_partkey AS needs FROM part WHERE p_partkey % 17 > 0) USING (needs)")
def missing_references(spark, sf_dir):
    known = S.read(spark, sf_dir, "part").where("p_partkey % 17 > 0").select(F.col("p_partkey").alias("needs"))
    return S.prerequisite_edges(spark, sf_dir).join(known, "needs", "left_anti").select("course", "needs")


@query(f"SELECT p_partkey, contains(lower(p_name), lower(title)) AS verified FROM part JOIN (SELECT {CODE} AS code, min(p_name) AS title FROM part GROUP BY 1) ON code = {CODE}")
def title_verify(spark, sf_dir):
    rows = S.read(spark, sf_dir, "part").select("p_partkey", "p_name", _code().alias("code"))
    return rows.join(S.courses(spark, sf_dir).select("code", "title"), "code").select("p_partkey", F.contains(F.lower("p_name"), F.lower("title")).alias("verified"))


@query("SELECT a.event_id AS section, b.event_id AS partner FROM events a JOIN events b ON b.event_id = a.event_id + a.event_id % 5 AND a.event_id % 5 > 0")
def co_enroll(spark, sf_dir):
    section = F.col("event_id")
    note = F.when(section % 5 > 0, F.concat(F.lit("Requires co-enrollment with section "), (section + section % 5).cast("string"), F.lit(".")))
    rows = S.read(spark, sf_dir, "events").select(section.alias("section"), F.nullif(F.regexp_extract(note, r"(?i)co-enrollment with section (\d+)", 1), F.lit("")).cast("long").alias("partner"))
    return rows.where("partner is not null").join(rows.select(F.col("section").alias("partner")), "partner").select("section", "partner")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN filled ELSE p_name END AS description FROM part JOIN (SELECT p_type, min(p_name) FILTER (p_size % 4 > 0) AS filled FROM part GROUP BY 1) USING (p_type)")
def placeholder_fill(spark, sf_dir):
    said = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Please see the "), "p_type", F.lit(" section."))).otherwise(F.col("p_name"))
    rows = S.read(spark, sf_dir, "part").select("p_partkey", "p_type", said.alias("description"))
    pattern = r"^Please see the (.+) section"
    given = rows.where(~F.col("description").rlike(pattern)).groupBy(F.col("p_type").alias("named")).agg(F.min("description").alias("filled"))
    rows = rows.withColumn("named", F.nullif(F.regexp_extract("description", pattern, 1), F.lit("")))
    return rows.join(given, "named", "left").select("p_partkey", F.coalesce("filled", "description").alias("description"))
