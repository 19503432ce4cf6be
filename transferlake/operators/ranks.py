"""Row numbers within keys that may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved


def numbered(rows: DataFrame, key: str, bucket: Column, *order: Column | str) -> DataFrame:
    """rows with ``place``, their number from 1 within ``key`` in the order given, and ``size``, the rows of the key.

    bucket must not fall as the order rises. Rows are counted by (key, bucket) before they are dealt, and a row's place is the count of the buckets
    before its own and its number within it, so a key meets in one task only with the counts of its buckets. Null keys are one key.
    """
    rows = saved(rows.withColumn("_bucket", bucket))
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(F.count("*").alias("_n"))
    within = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_n").over(within.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_key", "_of", before.alias("_before"), F.sum("_n").over(within).alias("size"))
    own = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    placed = rows.withColumn("_own", own)
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of"))
    return placed.join(bases, same).withColumn("place", F.col("_before") + F.col("_own")).drop("_bucket", "_key", "_of", "_before", "_own")
