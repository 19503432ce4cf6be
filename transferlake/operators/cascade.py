"""Questions answered by the first tier that has documents; a later tier is run only for questions that no earlier one answered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved

TIERS = ("group and section", "group", "course", "reverse", "semantic")


def cascade(questions: DataFrame, docs: DataFrame, nearest: Callable[[DataFrame], DataFrame], k: int = 5) -> tuple[DataFrame, dict[str, int]]:
    """((query, tier, rank, doc), {tier: questions that it was asked}): at most k documents of the first tier that has any for a question.

    questions(query, grp, section, uc, ccc), docs(doc, grp, section, uc, ccc): uc and ccc are courses, in docs one uc and an array of ccc, in questions arrays of both. Tiers: 1, group and section agree; 2, the group; 3, the
    uc course is among the question's and a ccc course too, or either where it names only one kind, or its uc courses alone where both find nothing; 4, documents that hold a ccc course; 5, those that
    ``nearest(questions)`` gives as (query, doc, place). Documents alike in course, group and section count once, the first by number; the order is that of their numbers, in tier 5 that of place.

    Each tier is an equi-join of the questions that are left, which are written before it, so that a tier reads no more of them than it is asked, and is skipped once none is left. What a question of the first four
    tiers meets under a key are the k first documents of that key, cut before, within partitions first: the k first of any union of keys are among the k first of each. So what it meets does not grow with the documents.
    Questions that name courses of both kinds meet them by pairs of a uc and a ccc course, and by uc course where that finds none.
    """
    first = saved(docs.groupBy("uc", "grp", "section").agg(F.min_by(F.struct("doc", "ccc"), "doc").alias("x")).select("x.doc", "uc", "grp", "section", F.col("x.ccc").alias("ccc")))
    left, found, asked = saved(questions), [], {}
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    each = lambda rows, c, name: rows.withColumn(name, F.explode(F.array_distinct(c)))

    def lowest(rows: DataFrame, *of: str) -> DataFrame:
        place = F.dense_rank().over(Window.partitionBy(*of).orderBy("doc"))
        return rows.where(" and ".join(f"{c} is not null" for c in of)).select(*of, "doc").withColumn("place", place).where(F.col("place") <= k).select(*of, "doc")

    by_uc = lambda q: each(q, "uc", "of").join(lowest(first.withColumn("of", F.col("uc")), "of"), "of").select("query", "doc")
    by_ccc = lambda q: each(q, "ccc", "of").join(lowest(each(first, "ccc", "of"), "of"), "of").select("query", "doc")

    def courses(q: DataFrame) -> DataFrame:
        pairs = lowest(each(first.withColumn("of", F.col("uc")), "ccc", "held"), "of", "held")
        both = saved(each(each(q, "uc", "of"), "ccc", "held").join(pairs, ["of", "held"]).select("query", "doc").distinct())
        forced = by_uc(q.where(some("uc")).join(both.select("query").distinct(), "query", "left_anti"))
        return both.unionAll(forced).unionAll(by_ccc(q.where(~some("uc") & some("ccc"))))

    steps = (
        lambda q: q.where("section is not null").join(lowest(first, "grp", "section"), ["grp", "section"]).select("query", "doc"),
        lambda q: q.join(lowest(first, "grp"), "grp").select("query", "doc"),
        courses,
        lambda q: by_ccc(q.where(some("ccc"))),
        nearest,
    )
    for number, (tier, step) in enumerate(zip(TIERS, steps, strict=True), 1):
        asked[tier] = left.count()
        if not asked[tier]:
            break
        rows = step(left)
        place = "place" if "place" in rows.columns else "doc"
        rank = F.row_number().over(Window.partitionBy("query").orderBy(place, "doc"))
        best = saved(rows.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query", F.lit(number).alias("tier"), "rank", "doc"))
        found.append(best)
        left = saved(left.join(best.select("query").distinct(), "query", "left_anti"))
    out = found[0] if found else questions.sparkSession.createDataFrame([], "query long, tier int, rank int, doc long")
    for more in found[1:]:
        out = out.unionAll(more)
    return out, asked
