"""Requirement logic as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logic, trees
from ..sources import agreements
from .queries import query
from .trees import CELLS

#: Every choice of cells that satisfies a group and its sections, with every choice of their options; of those the ones that hold no other.
WAYS = (
    CELLS.replace("WITH cell0", "WITH RECURSIVE cell0")
    + """, ser AS (SELECT DISTINCT a.agreement, a.grp, a.sec FROM cell a JOIN cell b ON a.agreement = b.agreement AND a.grp = b.grp AND a.sec = b.sec AND a.pos % 6 = 5 AND b.pos % 6 <> 5 AND a.prefix = b.prefix AND (a.number = b.number OR a.number || 'B' = b.number)),
u AS (SELECT f.agreement, f.group_id, f.grp, section, group_logic, group_n, CASE WHEN own_n IS NOT NULL THEN own_n WHEN ser.sec IS NOT NULL THEN 1 END AS n, row_number() OVER (PARTITION BY f.agreement, f.group_id ORDER BY section, pos) - 1 AS i,
  CASE WHEN {held} AND len(options) = 2 THEN [list_sort(list_distinct(flatten(options)))] ELSE list_transform(options, lambda o: list_sort(list_distinct(o))) END AS options FROM full_ f LEFT JOIN ser ON ser.agreement = f.agreement AND ser.grp = f.grp AND ser.sec = f.sec),
pick AS (SELECT *, (m >> i) % 2 = 1 AS taken FROM u, range(1, 16) r(m) WHERE m < (1 << (SELECT count(*) FROM u x WHERE x.agreement = u.agreement AND x.group_id = u.group_id))),
per AS (SELECT agreement, group_id, m, section, any_value(group_logic) AS group_logic, any_value(group_n) AS group_n, count(*) AS cells, count_if(taken) AS took, count_if(taken) >= least(coalesce(any_value(n), count(*)), count(*)) AS met FROM pick GROUP BY ALL),
ok AS (SELECT agreement, group_id, m FROM per GROUP BY ALL HAVING CASE any_value(group_logic) WHEN 'select_n_courses' THEN sum(took) >= least(any_value(group_n), sum(cells)) WHEN 'choose_one_section' THEN bool_or(met) ELSE bool_and(met) END),
chain AS (SELECT agreement, group_id, m, i, options, row_number() OVER (PARTITION BY agreement, group_id, m ORDER BY i) AS step FROM pick SEMI JOIN ok USING (agreement, group_id, m) WHERE taken),
made AS (
  SELECT agreement, group_id, m, 0 AS step, []::VARCHAR[] AS way FROM ok
  UNION ALL SELECT made.agreement, made.group_id, made.m, chain.step, list_sort(list_distinct(way || o)) FROM made JOIN chain ON made.agreement = chain.agreement AND made.group_id = chain.group_id AND made.m = chain.m AND chain.step = made.step + 1, LATERAL (SELECT unnest(options) AS o)),
w AS (SELECT DISTINCT agreement, group_id, way FROM made JOIN (SELECT agreement, group_id, m, max(step) AS last FROM chain GROUP BY ALL) USING (agreement, group_id, m) WHERE step = last),
least_ AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM w v WHERE v.agreement = w.agreement AND v.group_id = w.group_id AND len(v.way) < len(w.way) AND list_has_all(w.way, v.way)))
SELECT agreement, group_id, (row_number() OVER (PARTITION BY agreement, group_id ORDER BY len(way), way) - 1)::INT AS option, array_to_string(way, ' AND ') AS courses FROM least_"""
)


def _trees(spark, sf_dir):
    return trees.trees(agreements.raw_agreements(spark, sf_dir))


def _listed(ways):
    each = ways.select("tree.agreement", "tree.group_id", F.posexplode_outer("ways").alias("option", "way")).where("option is not null")  # outer: no filter repeats the making of the ways
    return each.select("agreement", "group_id", "option", F.array_join("way", " AND ").alias("courses"))


@query(WAYS.replace("{held}", "false"))
def logic_ways(spark, sf_dir):
    """Every minimal way to satisfy each group of each agreement, from nested trees of five levels."""
    return _listed(logic.tree_ways(_trees(spark, sf_dir)))


@query(WAYS.replace("{held}", "f.agreement % 4 = 1"))
def logic_ranges(spark, sf_dir):
    """The same, where both options of a requirement hold together in a quarter of the agreements: a range over their positions."""
    return _listed(logic.tree_ways(_trees(spark, sf_dir), F.col("agreement") % 4 == 1))
