"""Task events as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def finished_by_tool(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(plan, tool, n) of finished events, each event once; events(event_id, ts, plan, tool, state), batch or stream."""
    finished = events.where("state = 'finished'")
    if events.isStreaming:
        finished = finished.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    else:
        finished = finished.dropDuplicates(["event_id"])
    return finished.groupBy("plan", "tool").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, length: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """(window_start, state, n) per event-time window."""
    if events.isStreaming:
        events = events.withWatermark("ts", lateness)
    return events.groupBy(F.window("ts", length), "state").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "state", "n")


def plan_coverage(planned: DataFrame, finished: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(plan, planned, done, coverage, needs_more): distinct finished tools over distinct planned ones."""
    p = planned.groupBy("plan").agg(F.count_distinct("tool").alias("planned"))
    d = finished.groupBy("plan").agg(F.count_distinct("tool").alias("done"))
    coverage = F.round(F.coalesce("done", F.lit(0)) / F.col("planned"), 4)
    return p.join(d, "plan", "left").select("plan", "planned", F.coalesce("done", F.lit(0)).alias("done"), coverage.alias("coverage"), (coverage < threshold).alias("needs_more"))


UPDATE = "plan long, event_id long, ts timestamp, tool string, done long, planned long, coverage double"


def coverage_updates(events: DataFrame, planned: DataFrame, lateness: str = "1 hour", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """(plan, event_id, ts, tool, done, planned, coverage) after each finished event of a stream: the share of the plan's tools that have finished by then.

    events(event_id, ts, plan, tool, state); planned(plan, tool) is a table. The state of a plan is the set of its finished tools. Events that come again within ``lateness`` count once, started ones do
    not. The events of one batch are taken in the order of ts and event_id, whatever order they arrive in; what one plan has in one batch is held as numbers. A timer ends the state of a plan that has been idle for
    ``idle_ms`` of event time. Events of plans without planned tools, and without a plan or a tool, are left out.
    """
    sizes = planned.where("plan is not null and tool is not null").groupBy("plan").agg(F.count_distinct("tool").alias("planned"))
    finished = events.where("state = 'finished' and plan is not null and tool is not null").withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tools = list(state.get[0]) if state.exists else []
        number = {t: i for i, t in enumerate(tools)}
        held = [(c["ts"].to_numpy("datetime64[us]"), c["event_id"].to_numpy(), np.array([number.setdefault(t, len(number)) for t in c["tool"]], np.int64), c["planned"].to_numpy()) for c in chunks]
        ts, event, tool, size = (np.concatenate([h[i] for h in held]) for i in range(4))
        order = np.lexsort((event, ts))
        ts, event, tool, size = ts[order], event[order], tool[order], size[order]
        fresh = np.zeros(len(tool), bool)
        fresh[np.unique(tool, return_index=True)[1]] = True  # the first time in this batch
        done = len(tools) + np.cumsum(fresh & (tool >= len(tools)))
        names = np.array(list(number), object)
        state.update((list(number),))
        state.setTimeoutTimestamp(max(int(ts[-1].astype(np.int64)) // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"plan": key[0], "event_id": event, "ts": ts, "tool": names[tool], "done": done, "planned": size, "coverage": np.round(done / size, 4)})

    each = finished.join(sizes, "plan").select("plan", "event_id", "ts", "tool", "planned")
    return each.groupBy("plan").applyInPandasWithState(fold, UPDATE, "tools array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def run_updates(counts: DataFrame, folder: str) -> DataFrame:
    """What a streaming aggregate changed in each batch, with the batch's number, run until all that is there is read.

    Every batch is written below ``folder`` by its executors; a batch that runs again after a failure replaces its own rows.
    """
    spark, schema = counts.sparkSession, counts.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    run = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.lastProgress is None:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")
