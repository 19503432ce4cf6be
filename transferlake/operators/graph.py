"""Closure and levels of prerequisite graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import saved


def closure(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(root, reached) for every pair joined by a path of edges(course, needs); cycles end, a root may reach itself.

    Semi-naive: each round extends only the pairs that the last one found. A round writes those alone; the result is their union. All joins are merges: a side that
    adaptive execution finds small enough to broadcast would go through the driver, round after round.
    """
    e = saved(edges.select("course", "needs").distinct())
    seen = frontier = saved(e.select(F.col("course").alias("root"), F.col("needs").alias("reached")))
    for _ in range(max_rounds):
        step = frontier.join(e.hint("merge"), frontier.reached == e.course).select("root", F.col("needs").alias("reached")).distinct()
        frontier = saved(step.join(seen.hint("merge"), ["root", "reached"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionAll(frontier)
    raise RuntimeError(f"paths longer than {max_rounds}")


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(course, level): 0 without needs, else one above the highest need; null for members of a cycle and what needs them.

    Each round takes the nodes all of whose needs are placed, by merges as in ``closure``.
    """
    e = saved(edges.select("course", "needs").distinct())
    left = saved(nodes.select("course").distinct())
    done = None
    for level in range(max_rounds):
        waiting = e.join(left.select(F.col("course").alias("needs")).hint("merge"), "needs", "left_semi").select("course").distinct()
        ready = saved(left.join(waiting.hint("merge"), "course", "left_anti").select("course", F.lit(level).alias("level")))
        if ready.isEmpty():
            stuck = left.select("course", F.lit(None).cast("int").alias("level"))
            return stuck if done is None else done.unionAll(stuck)
        done = ready if done is None else saved(done.unionAll(ready))
        left = saved(left.join(ready.hint("merge"), "course", "left_anti"))
    raise RuntimeError(f"more than {max_rounds} levels")


def issues(nodes: DataFrame) -> DataFrame:
    """(plan, node, issue, detail) of nodes(plan, node, needs): ids that come several times, and dependencies that no node of the plan has."""
    repeated = nodes.groupBy("plan", "node").agg(F.count("*").alias("times")).where("times > 1").select("plan", "node", F.lit("repeated id").alias("issue"), F.col("times").cast("string").alias("detail"))
    known = nodes.select("plan", F.col("node").alias("needs")).distinct()
    unknown = nodes.where("needs is not null").distinct().join(known, ["plan", "needs"], "left_anti")
    return repeated.unionAll(unknown.select("plan", "node", F.lit("unknown dependency"), F.col("needs").cast("string")))
