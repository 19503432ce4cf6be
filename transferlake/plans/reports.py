"""Audit reports as queries; importing this module registers them with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, trees
from ..sources import agreements
from ..sources import stand_ins as S
from .queries import query
from .trees import CELLS


@query(
    CELLS
    + f""", taken AS (SELECT DISTINCT o_custkey AS student, 'SUP ' || l_suppkey AS code FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'AP BIO' ELSE 'IB ART' END FROM customer WHERE c_custkey % 10 = 0),
r AS (SELECT o_custkey AS student, f.agreement, group_id, section AS section_id, row_number() OVER (PARTITION BY f.agreement, group_id, section ORDER BY pos) - 1 AS place, course AS uc_course, options FROM full_ f JOIN orders ON o_orderkey = f.agreement),
o AS (SELECT student, agreement, group_id, section_id, place, i AS option, list_sort(list_distinct(options[i])) AS codes FROM r, LATERAL (SELECT unnest(range(1, len(options) + 1)) AS i)),
m AS (SELECT o.student, agreement, group_id, section_id, place, option, codes, len(codes) AS n, list(c.code ORDER BY c.code) FILTER (t.code IS NULL) AS lacks, count(t.code) AS matched FROM (SELECT *, unnest(codes) AS code FROM o) c JOIN o USING (student, agreement, group_id, section_id, place, option, codes) LEFT JOIN taken t ON t.student = o.student AND t.code = c.code GROUP BY ALL),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY student, agreement, group_id, section_id, place ORDER BY matched / n DESC, option) = 1),
u AS (SELECT student, agreement, unnest(codes) AS code FROM b WHERE matched = n), v AS (SELECT student, agreement, code FROM u GROUP BY ALL HAVING count(*) > 1)
SELECT r.student, r.agreement, r.group_id, r.section_id, r.place::INT AS place, r.uc_course, CASE WHEN matched = n THEN 'satisfied' WHEN matched > 0 THEN 'partial' ELSE 'missing' END AS status, coalesce(round(matched * 100.0 / n, 2), 0)::DOUBLE AS percent,
  CASE WHEN matched = n THEN array_to_string(codes, ' AND ') ELSE '' END AS satisfied_by, CASE WHEN len(r.options) = 0 THEN 'no course articulated' WHEN matched = n THEN '' ELSE array_to_string(lacks, ', ') END AS missing,
  coalesce(CASE WHEN matched = n THEN (SELECT string_agg(code, ', ' ORDER BY code) FROM v WHERE v.student = r.student AND v.agreement = r.agreement AND list_contains(b.codes, v.code)) END, '') AS reused,
  CASE WHEN r.student IN (SELECT student FROM taken WHERE contains(code, 'AP') OR contains(code, 'IB')) THEN '{reports.OUTSIDE_NOTE}' ELSE '' END AS note
FROM r LEFT JOIN b USING (student, agreement, group_id, section_id, place)"""
)
def audit_report(spark, sf_dir):
    """Every requirement of a student's own agreements with the reasons for its status; the requirements grow with the lines of orders."""
    own = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("agreement"), F.col("o_custkey").alias("student"))
    lines = S.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("agreement"), F.concat(F.lit("SUP "), F.col("l_suppkey").cast("string")).alias("code"))
    k = F.col("c_custkey")
    outside = S.read(spark, sf_dir, "customer").where(k % 10 == 0).select(k.alias("student"), F.when(k % 20 == 0, "AP BIO").otherwise("IB ART").alias("code"))
    taken = lines.join(own, "agreement").select("student", "code").unionAll(outside)
    return reports.audit_of(trees.placed(agreements.raw_agreements(spark, sf_dir)).join(own, "agreement"), taken)
