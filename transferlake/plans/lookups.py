"""Lookups, page fields, graph checks and reports beside the first ones; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, text
from ..operators import graph, labels, matching
from ..sources import stand_ins as S
from .agreements import MENTIONED, _asked
from .catalog import CODE, _code
from .queries import query


@query("SELECT p_type || ' ' || p_brand AS grp, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, grp LIMIT 10")
def top_groups(spark, sf_dir):
    """The ten largest groups."""
    return S.read(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_type", "p_brand").alias("grp")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "grp").limit(10)


@query(f"SELECT {CODE.split(' || ')[0]} AS prefix, count(DISTINCT {CODE}) AS codes, min({CODE}) AS first_code FROM part GROUP BY 1")
def code_prefixes(spark, sf_dir):
    rows = S.read(spark, sf_dir, "part").select(F.col("p_type").alias("prefix"), _code().alias("code"))
    return rows.groupBy("prefix").agg(F.count_distinct("code").alias("codes"), F.min("code").alias("first_code"))


@query(f"""WITH {MENTIONED}, d AS (SELECT p_partkey AS query, 0 AS rank, p_type || ' ' || (p_size + 1) AS code FROM part UNION ALL SELECT p_partkey, 1, p_type || ' ' || p_size FROM part UNION ALL SELECT p_partkey, 2, p_type || ' 2' FROM part UNION ALL SELECT p_partkey, 3, 'PROMO 3' FROM part),
k AS (SELECT d.query, rank, code, list_contains(l, code) AS said FROM d JOIN m ON d.query = m.query)
SELECT query, rank, code FROM k QUALIFY said OR (rank = 0 AND NOT bool_or(said) OVER (PARTITION BY query))""")
def relevant_courses(spark, sf_dir):
    """Of the courses found for a question those that it mentions, or the first if it mentions none of them."""
    kinds = [F.concat_ws(" ", "p_type", (F.col("p_size") + 1).cast("string")), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")), F.concat("p_type", F.lit(" 2")), F.lit("PROMO 3")]
    found = S.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), F.posexplode(F.array(*kinds)).alias("rank", "code"))
    said = matching.mentions(_asked(spark, sf_dir)).select("query", "code").distinct()
    return matching.mentioned_or_first(found, said)


@query(
    r"""WITH b AS (SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '') AS heading, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', ' ', 'g') AS bare FROM pages),
p AS (SELECT page_id, heading, list_slice(list_filter(list_transform(regexp_extract_all(bare, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), 1, 3) AS l, list_sort(list_distinct(regexp_extract_all(regexp_replace(bare, '<[^>]*>', ' ', 'g'), '\b([BM]\.?[SA]\.?)(?:\s|$)', 1))) AS d FROM b)
SELECT page_id, heading, array_to_string(l, chr(10)) AS description, array_to_string(d, ', ') AS degrees FROM p"""
)
def html_fields(spark, sf_dir):
    return S.read(spark, sf_dir, "pages").select("page_id", text.heading(F.col("html")).alias("heading"), F.array_join(text.paragraphs(F.col("html"), 3), "\n").alias("description"), F.array_join(text.degrees(F.col("html")), ", ").alias("degrees"))


_KEY = "(o_orderkey % 90 + 10) || '/' || o_custkey || '/to/' || (o_orderkey % 13) || '/Major/' || o_orderpriority"


@query(f"SELECT o_orderkey, (o_orderkey % 90 + 10)::VARCHAR AS year, o_custkey::VARCHAR AS institution, (o_orderkey % 13)::VARCHAR AS agreement, o_orderpriority AS major, 'https://agreements.example.org/results?year=' || (o_orderkey % 90 + 10) || '&institution=' || o_custkey || '&agreement=' || (o_orderkey % 13) || '&viewByKey=' || replace(replace({_KEY}, '/', '%2F'), ' ', '+') AS url FROM orders")
def url_round_trip(spark, sf_dir):
    """Addresses composed from an agreement's parts and taken apart again; the major is the last of six parts or more of the key."""
    o = F.col("o_orderkey")
    parts = S.read(spark, sf_dir, "orders").select("o_orderkey", codes.agreement_url((o % 90 + 10).cast("string"), F.col("o_custkey").cast("string"), (o % 13).cast("string"), F.col("o_orderpriority")).alias("url"))
    return parts.select("o_orderkey", *(codes.url_part(F.col("url"), name).alias(name) for name in ("year", "institution", "agreement")), codes.url_major(F.col("url")).alias("major"), "url")


@query(
    r"""SELECT p_partkey, replace(replace(trim(replace(replace(replace(replace(lower(p_name || ' & ' || p_brand || ': B.S.'), '&', 'and'), '-', ''), '.', ''), ':', '')), '  ', ' '), ' ', '_') AS plain,
  trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (' || p_type || ') B.S. ' || p_brand), '\(.*?\)', '', 'g'), '\b[bm]\.?[as]\.?\b', '', 'g'), '\s+', ' ', 'g')), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_') AS bare FROM part"""
)
def slug_rules(spark, sf_dir):
    name = lambda *parts: F.concat(*(F.col(p) if p.startswith("p_") else F.lit(p) for p in parts))
    return S.read(spark, sf_dir, "part").select("p_partkey", codes.file_slug(name("p_name", " & ", "p_brand", ": B.S.")).alias("plain"), codes.bare_slug(name("p_name", " (", "p_type", ") B.S. ", "p_brand")).alias("bare"))


@query("SELECT p_partkey, p_size::DOUBLE AS least, (p_size + p_partkey % 3)::DOUBLE AS most FROM part")
def unit_range(spark, sf_dir):
    """Least and most units of texts such as ``3 - 5 units`` and ``4.0``."""
    more = F.col("p_partkey") % 3
    said = F.when(more > 0, F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + more).cast("string"), F.lit(" units"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return S.read(spark, sf_dir, "part").select("p_partkey", codes.unit_range(said).alias("r")).select("p_partkey", "r.least", "r.most")


@query(
    """WITH n AS (SELECT user_id AS plan, event_id % 40 AS node, event_id % 40 + CASE WHEN event_id % 7 = 0 THEN -1 ELSE 3 END AS needs FROM events), e AS (SELECT DISTINCT plan, node, needs FROM n),
k AS (SELECT DISTINCT plan, node FROM n), r AS (SELECT plan, node, count(*) AS times FROM n GROUP BY ALL HAVING count(*) > 1), u AS (SELECT DISTINCT e.plan, e.node, e.needs FROM e ANTI JOIN k ON e.plan = k.plan AND e.needs = k.node)
SELECT plan, node, 'repeated id' AS issue, times::VARCHAR AS detail FROM r UNION ALL SELECT plan, node, 'unknown dependency', needs::VARCHAR FROM u"""
)
def dag_issues(spark, sf_dir):
    event = F.col("event_id")
    nodes = S.read(spark, sf_dir, "events").select(F.col("user_id").alias("plan"), (event % 40).alias("node"), (event % 40 + F.when(event % 7 == 0, -1).otherwise(3)).alias("needs"))
    return graph.issues(nodes)


@query(
    """WITH j AS (SELECT quality AS truth, (doc_id % 3 > 0)::INT AS pred FROM labels), x AS (SELECT truth AS label, 1 AS t, 0 AS p, 0 AS h FROM j UNION ALL SELECT pred, 0, 1, (truth = pred)::INT FROM j),
s AS (SELECT label, sum(t)::BIGINT AS support, sum(p) AS said, sum(h) AS hits FROM x GROUP BY 1)
SELECT round(sum(coalesce(2 * hits / nullif(said + support, 0), 0) * support) / sum(support), 4)::DOUBLE AS weighted_f1, sum(support)::BIGINT AS support FROM s"""
)
def weighted_f1(spark, sf_dir):
    return labels.weighted_f1(S.read(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), (F.col("doc_id") % 3 > 0).cast("int").alias("pred")))


@query("SELECT user_id AS plan, event_type AS tool, count(*) AS n, array_to_string(list_sort(list(event_id)), ',') AS outputs FROM events WHERE event_id % 2 = 0 GROUP BY ALL")
def merged_outputs(spark, sf_dir):
    """Outputs of a plan's tools, one list a tool: node ids are ``tool#number``."""
    finished = S.read(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.col("user_id").alias("plan"), F.concat_ws("#", "event_type", "event_id").alias("node"), F.col("event_id").alias("output"))
    per = finished.groupBy("plan", F.split_part("node", F.lit("#"), F.lit(1)).alias("tool")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("output")).alias("o"))
    return per.select("plan", "tool", "n", F.array_join(F.col("o").cast("array<string>"), ",").alias("outputs"))


@query(
    """SELECT p_type AS department, count(*) AS n, count_if(regexp_matches(p_name || CASE WHEN p_size % 9 = 0 THEN ' AND' WHEN p_size % 11 = 0 THEN ' of' ELSE '' END, '(?i) (and|to|of|in|for|the|with)$'))::BIGINT AS truncated, count_if(p_size % 7 = 0)::BIGINT AS no_units,
  array_to_string(list_slice(list_sort(list(p_partkey) FILTER (p_size % 9 = 0 OR p_size % 11 = 0)), 1, 3), ',') AS samples FROM part GROUP BY 1"""
)
def title_checks(spark, sf_dir):
    """Titles that end in a connective, rows without units, and the first three of such titles."""
    size = F.col("p_size")
    title = F.concat("p_name", F.when(size % 9 == 0, " AND").when(size % 11 == 0, " of").otherwise(""))
    cut = title.rlike(r"(?i) (and|to|of|in|for|the|with)$")
    rows = S.read(spark, sf_dir, "part").select("p_type", "p_partkey", cut.alias("cut"), F.when(size % 7 > 0, size).alias("units"))
    first = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    samples = rows.where("cut").select("p_type", "p_partkey", first.alias("place")).where("place <= 3").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")).cast("array<string>"), ",").alias("samples"))
    counts = rows.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if("cut").alias("truncated"), F.count_if(F.col("units").isNull()).alias("no_units"))
    return counts.join(samples, "p_type", "left").select(F.col("p_type").alias("department"), "n", "truncated", "no_units", "samples")


@query(f"SELECT c_custkey AS request, upper(trim(' sect ' || (c_custkey % 400))) AS section, e.event_id IS NOT NULL AS found, e.event_type AS title FROM customer LEFT JOIN events e ON e.event_id = c_custkey % 400 AND e.event_id % 3 > 0")
def lookup_sections(spark, sf_dir):
    number = F.col("c_custkey") % 400
    asked = S.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request"), F.upper(F.trim(F.concat(F.lit(" sect "), number.cast("string")))).alias("section"))
    known = S.read(spark, sf_dir, "events").where("event_id % 3 > 0").select(F.concat(F.lit("SECT "), F.col("event_id").cast("string")).alias("section"), F.col("event_type").alias("title"))
    return matching.looked_up(asked, known, "section")


@query("SELECT o_orderkey AS request, 'U' || (o_custkey + o_orderkey % 2 * 1000000) AS profile, c_custkey IS NOT NULL AS found, c_custkey % 60 AS units FROM orders LEFT JOIN customer ON c_custkey = o_custkey + o_orderkey % 2 * 1000000")
def lookup_profile(spark, sf_dir):
    person = F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000
    asked = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.upper(F.trim(F.concat(F.lit(" u"), person.cast("string"), F.lit(" ")))).alias("profile"))
    known = S.read(spark, sf_dir, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("profile"), (F.col("c_custkey") % 60).alias("units"))
    return matching.looked_up(asked, known, "profile")


@query("SELECT o_custkey AS owner, o_orderkey AS event, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate::DATE END NULLS LAST, CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, o_orderkey)::INT AS place FROM orders")
def deadline_priority(spark, sf_dir):
    """Events by date, unknown ones last, then by priority: high, medium, low."""
    o = F.col("o_orderkey")
    starts = F.when(o % 6 > 0, F.to_date("o_orderdate"))
    priority = F.when(o % 3 == 0, "high").when(o % 3 == 1, "medium").otherwise("low")
    rank = F.create_map(*(F.lit(x) for pair in (("high", 0), ("medium", 1), ("low", 2)) for x in pair))
    rows = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), o.alias("event"), starts.alias("starts"), rank[priority].alias("priority"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.col("starts").asc_nulls_last(), "priority", "event"))
    return rows.select("owner", "event", place.alias("place"))
