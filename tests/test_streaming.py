"""Coverage after each update: order within batches, restarts, repeated events and idle plans."""

from transferlake.streaming import tasks

EVENT = "event_id long, ts timestamp, plan long, tool string, state string"


def updates(spark, folder, planned, **options):
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rows = tasks.run_updates(tasks.coverage_updates(events, planned, **options), f"{folder}/out")
    return {(r.plan, r.event_id): (r.tool, r.done, r.planned, r.coverage) for r in rows.collect()}


def write(spark, folder, rows):
    import datetime as d

    at = lambda h: d.datetime(2024, 1, 1) + d.timedelta(hours=h)
    spark.createDataFrame([(e, at(h), p, t, s) for e, h, p, t, s in rows], EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_each_update_has_its_ratio_over_batches_and_a_restart(spark, tmp_path):
    planned = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "a"), (2, "a"), (None, "a"), (4, None)], "plan long, tool string")
    write(spark, tmp_path, [(3, 2.0, 1, "b", "finished"), (1, 1.0, 1, "a", "finished"), (2, 1.0, 1, "a", "finished"), (9, 0.0, 1, "c", "started"), (5, 1.0, 2, "a", "finished")])
    first = updates(spark, tmp_path, planned)
    assert first == {(1, 1): ("a", 1, 3, 0.3333), (1, 2): ("a", 1, 3, 0.3333), (1, 3): ("b", 2, 3, 0.6667), (2, 5): ("a", 1, 1, 1.0)}
    # another run goes on with the state of the first: a repeated event, a tool that has finished, a new one, plans that are not planned
    write(spark, tmp_path, [(3, 2.0, 1, "b", "finished"), (10, 2.5, 1, "a", "finished"), (11, 2.6, 1, "c", "finished"), (12, 2.6, 3, "a", "finished"), (13, 2.6, None, "a", "finished"), (14, 2.6, 4, None, "finished")])
    assert updates(spark, tmp_path, planned) == first | {(1, 10): ("a", 2, 3, 0.6667), (1, 11): ("c", 3, 3, 1.0)}


def test_idle_plans_lose_their_state(spark, tmp_path):
    planned = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "plan long, tool string")
    for hours, plan, tool in ((0, 1, "a"), (50, 2, "a"), (100, 2, "a"), (101, 1, "b")):
        write(spark, tmp_path, [(1000 + hours, float(hours), plan, tool, "finished")])
        got = updates(spark, tmp_path, planned, idle_ms=10 * 3_600_000)
    assert got[1, 1000][1:] == (1, 2, 0.5) and got[1, 1101][1:] == (1, 2, 0.5)


def test_no_events_give_no_rows(spark, tmp_path):
    planned = spark.createDataFrame([(1, "a")], "plan long, tool string")
    spark.createDataFrame([], EVENT).write.parquet(f"{tmp_path}/in")
    assert updates(spark, tmp_path, planned) == {}
