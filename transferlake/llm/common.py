"""What the corpus operators share: reading tables, lineage cuts, components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import saved

#: Characters of text that one slice of a batch may hold before it is handed on.
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder that the cluster names in ``spark.checkpoint.dir``."""
    return saved(df)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive row ranges of a batch; a null text is an empty one.

    A range ends once its texts pass ``limit`` characters, so that memory follows the longest text
    and not the number of rows in a batch.
    """
    texts = batch.column(column)
    start, chars, held = 0, 0, []
    for i in range(len(texts)):
        held.append(texts[i].as_py() or "")
        chars += len(held[-1])
        if chars >= limit:
            yield start, held
            start, chars, held = i + 1, 0, []
    if held:
        yield start, held


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected graph ``edges(src, dst)``.

    component is the smallest node that can be reached, itself included. Self loops keep their
    node, repeated edges count once, edges with a null end are left out, no edges give no rows.

    Large-star and small-star steps alternate until the edges form stars around the smallest node
    of each component. A step is a minimum per node, written to the checkpoint folder, and an equi-join
    with it, so that both sides of the join are plain exchanges that adaptive execution can split:
    a node that touches a third of all edges does not stay in one task.
    """
    spark = edges.sparkSession
    e = checkpointed(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null").distinct())
    loops = e.where("u = v").select("u").distinct()
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    loops, e = checkpointed(loops), checkpointed(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = checkpointed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
    return stars.unionAll(loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(stars.select("node"), "node", "left_anti"))
