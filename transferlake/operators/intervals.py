"""Meetings that overlap and events within dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def schedule_conflicts(meetings: DataFrame) -> DataFrame:
    """(owner, first, second, day) of meetings of one owner that share a day and overlap; touching is no conflict.

    An equi-join on (owner, day, hour block) finds the candidates, so that a busy owner's day does not meet itself whole; a pair
    counts in the block where the later one begins.
    """
    cells = meetings.where("begins < ends").withColumn("block", F.explode(F.sequence(F.floor(F.col("begins") / 60), F.floor((F.col("ends") - 1) / 60))))
    a, b = cells.alias("a"), cells.alias("b")
    same = (F.col("a.owner") == F.col("b.owner")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.block") == F.col("b.block"))
    overlap = (F.col("a.begins") < F.col("b.ends")) & (F.col("b.begins") < F.col("a.ends")) & (F.col("a.section") < F.col("b.section"))
    own_block = F.col("a.block") == F.floor(F.greatest("a.begins", "b.begins") / 60)
    return a.join(b, same & overlap & own_block).select(F.col("a.owner").alias("owner"), F.col("a.section").alias("first"), F.col("b.section").alias("second"), F.col("a.day").alias("day"))


def date_overlaps(events: DataFrame, windows: DataFrame) -> DataFrame:
    """(query, event) where the event's days meet the query's, ends included; unknown dates never do.

    Both sides are laid out by month and joined on it; a pair counts in the month where the later one begins.
    """
    month = lambda a, b: F.explode(F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month")))
    e = events.where("starts <= ends").withColumn("month", month("starts", "ends"))
    q = windows.where("first_day <= last_day").withColumn("month", month("first_day", "last_day"))
    meets = (F.col("starts") <= F.col("last_day")) & (F.col("ends") >= F.col("first_day"))
    return e.join(q, "month").where(meets & (F.col("month") == F.trunc(F.greatest("starts", "first_day"), "month"))).select("query", "event")
