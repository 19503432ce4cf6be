"""The five tiers of matching as a query; importing this module registers it with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade, search
from ..sources import agreements
from ..sources import stand_ins as S
from .queries import query


def questions_and_documents(spark, sf_dir):
    """A document for each cell of the agreements, a question for each customer: some name a group, some courses of either side, some nothing."""
    say = lambda *x: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in x))
    supp, k = F.col("supp"), F.col("c_custkey")
    ccc = F.when(F.col("qty") % 2 == 0, F.array(say("SUP ", supp.cast("string")), say("SUP ", (supp + 1).cast("string")))).otherwise(F.array(say("SUP ", supp.cast("string"))))
    docs = agreements.cells(spark, sf_dir).select((F.col("agreement") * 10 + F.col("pos")).cast("long").alias("doc"), (F.col("agreement") % 997).alias("grp"), F.char(F.lit(65) + (F.col("pos") - 1) % 2).alias("section"), F.concat("prefix", F.lit(" "), "number").alias("uc"), ccc.alias("ccc"))
    grp = F.when((k % 5).isin(0, 1), k % 1200)
    asked = S.read(spark, sf_dir, "customer").select(
        k.alias("query"),
        grp.alias("grp"),
        F.when(k % 5 == 0, F.char(F.lit(65) + k % 3)).alias("section"),
        F.when((k % 5).isin(1, 2), F.array(say("ECONOMY ", (k % 80).cast("string")))).alias("uc"),
        F.when((k % 5).isin(2, 3), F.array(say("SUP ", (k % 300).cast("string")))).alias("ccc"),
    )
    return asked, docs


@query(
    """WITH cell AS (SELECT l_orderkey AS agreement, l_linenumber AS pos, min(l_partkey) AS part, min(l_suppkey) AS supp, max(l_quantity)::INT AS qty FROM lineitem GROUP BY ALL),
d0 AS (SELECT agreement * 10 + pos AS doc, agreement % 997 AS grp, chr((65 + (pos - 1) % 2)::INT) AS section, p_type || ' ' || regexp_extract(p_brand, '([0-9]+)', 1) AS uc, CASE WHEN qty % 2 = 0 THEN ['SUP ' || supp, 'SUP ' || (supp + 1)] ELSE ['SUP ' || supp] END AS ccc FROM cell JOIN part ON part = p_partkey),
d AS (SELECT * FROM d0 QUALIFY row_number() OVER (PARTITION BY uc, grp, section ORDER BY doc) = 1),
q AS (SELECT c_custkey AS query, CASE WHEN c_custkey % 5 IN (0, 1) THEN c_custkey % 1200 END AS grp, CASE WHEN c_custkey % 5 = 0 THEN chr((65 + c_custkey % 3)::INT) END AS section,
  CASE WHEN c_custkey % 5 IN (1, 2) THEN 'ECONOMY ' || (c_custkey % 80) END AS uc, CASE WHEN c_custkey % 5 IN (2, 3) THEN 'SUP ' || (c_custkey % 300) END AS ccc FROM customer),
both_ AS (SELECT query, doc, list_contains(d.ccc, q.ccc) AS fits, q.ccc IS NULL AS alone FROM q JOIN d ON q.uc = d.uc),
t3 AS (SELECT query, doc FROM both_ QUALIFY alone OR fits OR NOT bool_or(fits) OVER (PARTITION BY query) UNION SELECT query, doc FROM q JOIN d ON q.uc IS NULL AND list_contains(d.ccc, q.ccc)),
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 4) DESC, b.vec_id) AS place
  FROM q JOIN e a ON a.vec_id = query JOIN e b ON b.vec_id <> query JOIN d0 ON doc = b.vec_id QUALIFY place <= 5),
f AS (SELECT query, 1 AS tier, doc, doc AS place FROM q JOIN d USING (grp, section) UNION ALL SELECT query, 2, doc, doc FROM q JOIN d USING (grp) UNION ALL SELECT query, 3, doc, doc FROM t3
  UNION ALL SELECT query, 4, doc, doc FROM q JOIN d ON list_contains(d.ccc, q.ccc) UNION ALL SELECT query, 5, doc, place FROM s),
b AS (SELECT * FROM f QUALIFY tier = min(tier) OVER (PARTITION BY query))
SELECT query, tier, row_number() OVER (PARTITION BY query ORDER BY place)::INT AS rank, doc FROM b QUALIFY rank <= 5"""
)
def matching_cascade(spark, sf_dir):
    asked, docs = questions_and_documents(spark, sf_dir)
    vectors = S.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    held = vectors.join(docs.select(F.col("doc").alias("vec_id")).distinct(), "vec_id", "left_semi")

    def nearest(left):
        own = vectors.join(left.select(F.col("query").alias("vec_id")), "vec_id", "left_semi")
        return search.nearest(held, own).select("query_id", "rank", F.col("vec_id").alias("doc")).select(F.col("query_id").alias("query"), "doc", F.col("rank").alias("place"))

    return cascade.cascade(asked, docs, nearest)[0]
