"""Checks, summaries, file sinks and grouped searches as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines, quality, search
from ..sources import files, hard_lines
from ..sources import stand_ins as S
from .queries import BASE, LINES, _areas, _lines, query


@query(
    r"""SELECT doc_id, unnest(list_filter([CASE WHEN e THEN 'empty' END, CASE WHEN NOT e AND NOT regexp_matches(text, '^[ \t\r\n]*\p{Lu}') THEN 'no capital' END, CASE WHEN contains(text, chr(10)) THEN 'line break' END,
  CASE WHEN NOT e AND length(text) < 20 THEN 'short' END, CASE WHEN regexp_matches(text, '^[ \t\r\n]*(\p{Ll}|[^\p{L} \t\r\n])[^ \t\r\n]') THEN 'odd first word' END], lambda x: x IS NOT NULL)) AS violation
FROM (SELECT *, trim(coalesce(text, '')) = '' AS e FROM documents)"""
)
def field_lint(spark, sf_dir):
    return quality.violations(S.read(spark, sf_dir, "documents"), quality.text_rules(F.col("text")), "doc_id")


@query(
    r"""SELECT doc_id, unnest(list_filter([CASE WHEN text IS NULL THEN 'text missing' END, CASE WHEN lang IS NULL OR NOT regexp_matches(lang, '^[a-z]{2}\z') THEN 'bad lang' END, CASE WHEN source IS NULL OR source = '' THEN 'source missing' END,
  CASE WHEN n_chars <> length(text) THEN 'wrong length' END], lambda x: x IS NOT NULL)) AS violation FROM documents"""
)
def conformance(spark, sf_dir):
    t, lang, source = F.col("text"), F.col("lang"), F.col("source")
    rules = {"text missing": t.isNull(), "bad lang": lang.isNull() | ~lang.rlike(r"^[a-z]{2}\z"), "source missing": source.isNull() | (source == ""), "wrong length": F.col("n_chars") != F.length(t)}
    return quality.violations(S.read(spark, sf_dir, "documents"), rules, "doc_id")


@query(f"WITH {LINES} SELECT source, count(*) AS n, count_if(starts_with(line, '.'))::BIGINT AS leading_period, count_if(length(line) < 150)::BIGINT AS short, count_if(lang IS NULL)::BIGINT AS without_lang FROM ln JOIN documents USING (doc_id) GROUP BY 1")
def chunk_checks(spark, sf_dir):
    chunks = S.read(spark, sf_dir, "documents").select("source", "lang", F.explode(F.split("text", "\n")).alias("line"))
    return chunks.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.startswith("line", F.lit("."))).alias("leading_period"), F.count_if(F.length("line") < 150).alias("short"), F.count_if(F.col("lang").isNull()).alias("without_lang"))


#: What the tools of the stand-in plans take: tool, argument, pattern of its value. Other tools are unknown.
TOOL_RULES = [("view", "k", "^[0-9]+$"), ("click", "k", "^[0-9]$"), ("purchase", "k", "^[0-9]+$"), ("purchase", "amount", "^[0-9]+$")]


@query(
    f"""WITH r(tool, key, pattern) AS (VALUES {', '.join(map(str, TOOL_RULES))})
SELECT event_id AS node, 'unknown tool' AS violation FROM events WHERE event_type NOT IN (SELECT tool FROM r)
UNION ALL SELECT event_id, CASE WHEN v IS NULL THEN 'missing ' ELSE 'bad ' END || key FROM (SELECT event_id, key, pattern, props::JSON ->> key AS v FROM events JOIN r ON event_type = tool) WHERE v IS NULL OR NOT regexp_matches(v, pattern)"""
)
def plan_conformance(spark, sf_dir):
    nodes = S.read(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.col("event_type").alias("tool"), F.col("props").alias("args"))
    return quality.argument_violations(nodes, spark.createDataFrame(TOOL_RULES, "tool string, key string, pattern string"))


@query(
    BASE
    + """SELECT split_part(code, ' ', 1) AS department, grouping(split_part(code, ' ', 1))::INT AS level, count(DISTINCT code) AS courses, count(DISTINCT CASE WHEN active THEN code END) AS active_courses,
  count(DISTINCT CASE WHEN NOT active THEN code END) AS removed_courses, count(DISTINCT area) AS areas FROM areas GROUP BY ROLLUP (split_part(code, ' ', 1))"""
)
def master_summary(spark, sf_dir):
    return quality.master_summary(_areas(spark, sf_dir).withColumn("department", F.split_part("code", F.lit(" "), F.lit(1))))


_ANY = lambda test, values: "(" + " OR ".join(test.format("'" + v + "'") for v in values) + ")"
_GOES_ON = f"""({_ANY("ends_with(A_, {0})", quality.OPEN_ENDS)} OR {_ANY("contains(A_, {0})", quality.OPEN_PARTS)} OR {_ANY("starts_with(S_, {0})", quality.GOES_ON)} OR (NOT regexp_matches(A_, '[.!?:]\\z') AND regexp_matches(S_, '^\\p{{Ll}}'))
  OR (regexp_matches(A_, '(^|\\s)\\p{{Lu}}\\S*\\s*\\z') AND regexp_matches(S_, '^\\s*\\p{{Lu}}') AND NOT list_contains({quality.STARTERS}, rtrim(regexp_extract(S_, '^\\s*(\\S+)', 1), '.,;:'))) OR (ends_with(A_, ',') AND {_ANY("contains(lower(A_), {0})", quality.ADDRESSES)}))"""
_BETWEEN = "CASE WHEN (ends_with(A_, '/') AND NOT starts_with(S_, ' ')) OR (ends_with(A_, 'to smc.') AND starts_with(S_, 'edu/OnlineEd.')) THEN '' ELSE ' ' END"
#: A_ as the text of the last note so far, S_ as that of a line.
_FOLDED = lambda sql: sql.replace("A_", "split_part(list_last(string_split(a, chr(1))), chr(2), 2)").replace("S_", "split_part(s, chr(2), 2)")
#: The lines of a document as one text, notes parted by chr(1), each behind the number of its first line.
_MERGED = f"""f AS (SELECT doc_id, list_reduce(list(line_no || chr(2) || line ORDER BY line_no), lambda a, s: CASE WHEN {_FOLDED(_GOES_ON)} THEN a || {_FOLDED(_BETWEEN)} || split_part(s, chr(2), 2) ELSE a || chr(1) || s END) AS t FROM ln WHERE line IS NOT NULL GROUP BY 1),
n AS (SELECT doc_id, split_part(x, chr(2), 1)::INT AS first_line, split_part(x, chr(2), 2) AS text FROM (SELECT doc_id, unnest(string_split(t, chr(1))) AS x FROM f)),
e AS (SELECT *, lead(first_line) OVER (PARTITION BY doc_id ORDER BY first_line) AS next FROM n)
SELECT e.doc_id, first_line, count(*) AS n, any_value(text) AS text FROM e JOIN ln ON ln.doc_id = e.doc_id AND line_no >= first_line AND (next IS NULL OR line_no < next) WHERE line IS NOT NULL GROUP BY e.doc_id, first_line"""


@query(f"WITH {LINES}, {_MERGED}")
def merge_notes(spark, sf_dir):
    return quality.merge_notes(_lines(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber::INT AS line_no, min(l_partkey) AS part FROM lineitem GROUP BY ALL),
ln AS (SELECT doc_id, line_no, replace({hard_lines.FRAGMENTS}[((part + line_no * 7) % {len(hard_lines.FRAGMENTS)})::INT + 1], '#', part::VARCHAR) AS line FROM r), {_MERGED}"""
)
def merge_broken_notes(spark, sf_dir):
    """Notes broken at odd places: addresses over several lines, links, names, and notes that go on whatever follows."""
    return quality.merge_notes(hard_lines.note_lines(spark, sf_dir))


@query("SELECT p_type AS owner, min(p_partkey) AS place, p_size % 7 AS area, 2000 + p_size % 5 AS approved, CASE WHEN p_size % 3 = 0 THEN 2020 + p_size % 2 END AS removed FROM part GROUP BY ALL")
def area_merge(spark, sf_dir):
    """The first of each area with the same dates, in order of the list."""
    size = F.col("p_size")
    rows = S.read(spark, sf_dir, "part").select(F.col("p_type").alias("owner"), F.col("p_partkey").alias("place"), (size % 7).alias("area"), (2000 + size % 5).alias("approved"), F.when(size % 3 == 0, 2020 + size % 2).alias("removed"))
    ordered = rows.withColumn("at", F.col("place")).withColumn("key", F.struct("owner", "area", "approved", "removed"))
    return lines.first_of_each(ordered.drop("place"), "key", "at").select("owner", F.col("at").alias("place"), "area", "approved", "removed")


@query(
    BASE
    + """, mem AS (SELECT DISTINCT requirement, option, CASE WHEN number % 3 = 0 THEN code || 'H' ELSE code END AS target, number % 3 = 0 AS honors FROM opt JOIN course USING (code) WHERE requirement % 4 > 0 OR slot = 0),
ask AS (SELECT code FROM course UNION ALL SELECT code || 'H' FROM course), named AS (SELECT DISTINCT a.code, m.requirement FROM ask a JOIN mem m ON regexp_replace(lower(a.code), 'h$', '') = regexp_replace(lower(target), 'h$', '')),
o2 AS (SELECT n.code, requirement, option, bool_and(n.code = target) AS holds FROM named n JOIN mem USING (requirement) GROUP BY ALL), d AS (SELECT code, requirement, bool_or(holds) AS satisfied FROM o2 GROUP BY ALL),
l AS (SELECT n.code, requirement, string_agg(DISTINCT target || CASE WHEN honors THEN ' (Honors)' ELSE '' END, ', ' ORDER BY target || CASE WHEN honors THEN ' (Honors)' ELSE '' END) AS lacking FROM named n JOIN mem USING (requirement) WHERE n.code <> target GROUP BY ALL)
SELECT d.code, d.requirement, satisfied, CASE WHEN satisfied THEN '' ELSE coalesce(lacking, '') END AS lacking FROM d LEFT JOIN l ON d.code = l.code AND d.requirement = l.requirement"""
)
def single_course_check(spark, sf_dir):
    c = S.courses(spark, sf_dir)
    honors = F.col("number") % 3 == 0
    members = S.option_courses(spark, sf_dir).where("requirement % 4 > 0 or slot = 0").join(c.select("code", "number"), "code")
    members = members.select("requirement", "option", F.when(honors, F.concat("code", F.lit("H"))).otherwise(F.col("code")).alias("code"), honors.alias("honors"))
    return quality.single_course_check(c.select("code").unionAll(c.select(F.concat("code", F.lit("H")))), members)


@query(
    BASE
    + """, ch AS (SELECT DISTINCT l_orderkey AS student, p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) AS code FROM lineitem JOIN part ON l_partkey = p_partkey), w AS (SELECT student, count(*) AS n FROM ch GROUP BY 1),
mem AS (SELECT DISTINCT requirement % 3 AS grp, (requirement // 3) % 2 AS section, code, number % 4 > 0 AS ok FROM opt JOIN course USING (code)),
per AS (SELECT student, grp, section, count(*) AS held, bool_and(ok) AS satisfied, coalesce(string_agg(CASE WHEN NOT ok THEN code END, ', ' ORDER BY code), '') AS lacking FROM ch JOIN mem USING (code) GROUP BY ALL)
SELECT student, grp::INT AS grp, section::INT AS section, satisfied, lacking FROM per JOIN w USING (student) WHERE held = n"""
)
def section_choice_valid(spark, sf_dir):
    numbers = S.courses(spark, sf_dir).select("code", "number")
    chosen = S.order_courses(spark, sf_dir)
    r = F.col("requirement")
    members = S.option_courses(spark, sf_dir).join(numbers, "code").select((r % 3).alias("grp"), (F.floor(r / 3) % 2).cast("int").alias("section"), "code", (F.col("number") % 4 > 0).alias("articulated"))
    return quality.section_choice(chosen, members)


SCORED = """q AS (SELECT vec_id AS query_id, label AS own, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (
SELECT query_id, own, label, vec_id, round(list_dot_product(q, embedding::DOUBLE[]) / sqrt(list_dot_product(q, q) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS score FROM embeddings, q WHERE vec_id <> query_id)"""


@query(f"WITH {SCORED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, label % 3 AS index, vec_id, score FROM s QUALIFY rank <= 5")
def knn_multi(spark, sf_dir):
    """The best of three indexes, each searched by itself."""
    vectors = S.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("index"))
    asked = vectors.where("vec_id % 50 = 0").select("vec_id", "embedding", F.explode(F.array(*(F.lit(i).cast(vectors.schema["index"].dataType) for i in range(3)))).alias("index"))
    return quality.merged_nearest(search.nearest(vectors, asked, within="index").drop("rank"))


@query(f"WITH {SCORED} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, label AS index, vec_id, score FROM s WHERE own = label QUALIFY rank <= 5")
def knn_filtered(spark, sf_dir):
    """Among vectors with the query's own label: the filter is part of the tiles' key, ahead of the ranking."""
    vectors = S.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("index"))
    return search.nearest(vectors, vectors.where("vec_id % 50 = 0"), within="index").select("query_id", "rank", "index", "vec_id", "score")


# Sinks, written to a folder of their own and read again


@query("SELECT doc_id, text, lang, source FROM documents")
def jsonl_sink(spark, sf_dir):
    path = files.new_folder(spark, "jsonl")
    files.write_jsonl(S.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string, source string")


@query("SELECT event_id, user_id, event_type FROM events")
def partitioned_sink(spark, sf_dir):
    path = files.new_folder(spark, "groups")
    files.write_groups(S.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), path, "event_type")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(path)


@query("SELECT DISTINCT quality, toxic, doc_id AS id FROM labels")
def labeled_scan(spark, sf_dir):
    path = files.new_folder(spark, "labelled")
    S.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic").write.option("header", True).csv(path)
    return files.read_labelled(spark, path, "id long, quality int, toxic int", ["quality", "toxic"])
