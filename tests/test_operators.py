"""Hand fixtures for the engine's operators."""

import pytest
from pyspark.sql import functions as F

from transferlake.functions import codes, text, times
from transferlake.operators import academics, graph, intervals, labels, requirements


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def options(spark):
    data = [(1, 0, "A 1"), (1, 0, "B 2"), (1, 1, "C 3"), (2, 0, "A 1"), (3, 0, "D 4"), (3, 0, "E 5")]
    return spark.createDataFrame(data, "requirement int, option int, code string")


def test_requirement_satisfaction(spark, options):
    taken = spark.createDataFrame([(7, "A 1"), (7, "A 1"), (7, "C 3"), (8, "B 2"), (9, "Z 9")], "student int, code string")
    progress = requirements.option_progress(options, taken)
    assert rows(requirements.satisfied(progress), "student", "requirement", "option") == [(7, 1, 1), (7, 2, 0)]
    assert rows(requirements.best_partial(progress, options, taken), "student", "requirement", "option", "percent", "lacking") == [(8, 1, 0, 50.0, "A 1")]
    targets = spark.createDataFrame([(7, 1), (8, 1), (9, 3)], "student int, requirement int")
    assert rows(requirements.missing(targets, requirements.satisfied(progress)), "student", "requirement") == [(8, 1), (9, 3)]
    assert rows(requirements.audit(targets, progress), "student", "status", "all_satisfied") == [(7, "satisfied", True), (8, "partial", False), (9, "missing", False)]


def test_two_complete_sections_do_not_satisfy_choose_one(spark):
    members = spark.createDataFrame([(1, 0, 0, "choose_one_section", 1), (2, 0, 1, "choose_one_section", 1), (3, 1, 0, "all_required", 2), (4, 1, 0, "all_required", 2)], "requirement int, grp int, section int, logic string, n int")
    done = spark.createDataFrame([(7, 1), (8, 1), (8, 2), (7, 3), (8, 3), (8, 4)], "student int, requirement int")
    assert rows(requirements.group_status(done, members), "student", "grp", "satisfied") == [(7, 0, True), (7, 1, False), (8, 0, False), (8, 1, True)]


def test_touching_meetings_do_not_conflict(spark):
    data = [(1, 1, 1, 600, 660), (1, 2, 1, 660, 720), (1, 3, 1, 650, 800), (1, 4, 2, 600, 660), (2, 5, 1, 600, 660), (1, 6, 1, None, None)]
    meetings = spark.createDataFrame(data, "owner int, section int, day int, begins int, ends int")
    assert rows(intervals.schedule_conflicts(meetings), "first", "second") == [(1, 3), (2, 3)]


def test_gpa_is_cut_not_rounded_and_ignores_pass(spark):
    courses = spark.createDataFrame([("A 1", 3), ("B 2", 0)], "code string, units int")
    prior = spark.createDataFrame([(1, 3.0, 60), (2, 3.5, 0)], "student int, gpa double, units int")
    taken = spark.createDataFrame([(1, "A 1", "A-"), (1, "B 2", "F"), (2, "A 1", "P")], "student int, code string, grade string")
    assert rows(academics.projected_gpa(taken, courses, prior), "student", "gpa") == [(1, 3.03), (2, 3.5)]


def test_closure_ends_on_cycles_and_levels_report_them(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "course long, needs long")
    assert rows(graph.closure(edges), "root", "reached") == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)] + [(4, 5)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "course long")
    assert sorted(map(tuple, graph.levels(nodes, edges).collect()), key=str) == sorted([(1, None), (2, None), (3, None), (4, 1), (5, 0)], key=str)
    assert graph.closure(edges.where("false")).count() == 0


def test_codes_days_and_times(spark):
    one = spark.range(1)
    got = one.select(
        codes.course_code(F.lit(" math31a ")),
        codes.course_code(F.lit("see MATH 31A")),
        codes.course_code(F.lit("PHYSCS 21"), "search"),
        F.array_join(times.meeting_days(F.lit("TTh")).cast("array<string>"), ","),
        times.time_range(F.lit("9:30 a.m.–1:05 p.m."))["ends"],
        times.time_range(F.lit("Arrange"))["begins"],
        times.clock_minutes(F.lit("9:30")),
        codes.name_key(F.lit("Ada King")),
    ).first()
    assert tuple(got) == ("MATH 31A", None, "YSCS 21", "2,4", 785, None, None, "king|a")


def test_sentence_packing_keeps_text_and_limit(spark):
    t = "One two. Three four! Five? " + "x" * 30 + ". Six."
    chunks = spark.range(1).select(text.pack_sentences(F.lit(t), 20)).first()[0]
    assert chunks == ["One two. Three four!", "Five?", "x" * 30 + ".", "Six."]


def test_split_and_report(spark):
    data = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(30)], "id int, label string")
    assert rows(labels.stratified_split(data, 0.2).groupBy("label", "part").count(), "label", "part", "count") == [("a", "train", 16), ("a", "validation", 4), ("b", "train", 8), ("b", "validation", 2)]
    judged = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "truth string, pred string")
    assert rows(labels.classification_report(judged), "label", "precision", "recall", "support") == [("a", 1.0, 0.5, 2), ("b", 0.0, 0.0, 0), ("c", 0.0, 0.0, 1)]


def test_hyphens_at_line_ends_and_in_compounds(spark):
    from transferlake.operators import catalogue

    said = {"infor-\nmation": "infor-\nmation".replace("-\n", ""), "commu- nity": "community", "self- paced": "self- paced", "an- tic": "an- tic", "course- anywhere": "course- anywhere", "Long-\nTerm": "LongTerm", "pre- existing": "preexisting", "anti- oxidant": "antioxidant", "Half- life": "Half- life", "re- do": "re- do", "ver- ify it": "verify it", "go- abc- def": "go- abc- def", "A- Level": "A- Level", "non- smokers": "nonsmokers", "inter- est": "interest", "cour-\n  ses": "courses"}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", catalogue.without_breaks(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == said


def test_agreement_trees_on_hand_made_json(spark):
    import json

    from transferlake.operators import trees

    course = lambda p, n, units=4.0: {"prefix": p, "courseNumber": n, "courseTitle": f"{p} title", "units": units}
    cell = lambda i, c: {"id": i, "type": "Course", "course": c}
    assets = [
        {"position": 9, "type": "RequirementGroup", "instruction": {"conjunction": "Or", "selectionType": "Select"}, "sections": [{"rows": [{"position": 0, "cells": [cell("c", course("BIO", "1"))]}]}, {"rows": [{"position": 0, "cells": [cell("d", course("CHEM", "2"))]}]}]},
        {"position": 1, "type": "RequirementTitle", "content": "<p>Recommended&nbsp;</p> first"},
        {"position": 2, "type": "RequirementGroup", "sections": [{"rows": [{"position": 0, "cells": [cell("a", course("MATH", "1A", None)), {"id": "s", "type": "Series", "series": {"conjunction": "And", "courses": [course("PHYS", "1"), course("PHYS", "2", None)]}}]}]}, {"rows": []}]},
        {"position": 8, "type": "RequirementTitle", "content": "Then"},
        {"type": "GeneralText", "content": "no position"},
    ]
    sends = lambda *options: {"items": [{"position": k, "items": [{"prefix": "S", "courseNumber": n} for n in o]} for k, o in enumerate(options)]}
    arts = [{"templateCellId": "a", "articulation": sends(["1", "2"], ["3"])}, {"templateCellId": "a", "articulation": sends(["9"])}, {"templateCellId": "c", "articulation": {"items": [], "noArticulationReason": "None here"}}]
    raw = spark.createDataFrame([(1, "x", json.dumps(assets), json.dumps(arts)), (2, "bad", "{not json", None)], "agreement int, name string, templateAssets string, articulations string")
    flat = sorted((r.group_id, r.area, r.section, r.cell_id, r.sending_text) for r in trees.flatten(raw).collect())
    assert flat == [(1, "Recommended first", "A", "a", "S 9"), (1, "Recommended first", "A", "s", "No Course Articulated"), (2, "Then", "A", "c", "None here"), (2, "Then", "B", "d", "No Course Articulated")]
    rows = {r.uc_course_id: r for r in trees.requirements_of(trees.trees(raw)).collect()}
    assert (rows["MATH 1A"].units, rows["MATH 1A"].units_estimated, rows["MATH 1A"].recommended) == (4.0, True, True)
    assert (rows["PHYS 1 + PHYS 2"].units, rows["BIO 1"].group_logic_type, rows["BIO 1"].recommended) == (8.0, "choose_one_section", False)


def test_terms_in_short_form(spark):
    got = spark.createDataFrame([("F2017",), ("S2002",), ("Su2007",), ("W1999",), ("Fall 2020",), ("X2000",), ("",)], "t string").select("t", times.term_order(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == {"F2017": 201708, "S2002": 200201, "Su2007": 200706, "W1999": 199912, "Fall 2020": 202008, "X2000": None, "": None}


def test_plus_grades_count_and_the_simple_scale(spark):
    taken = spark.createDataFrame([(1, "A 1", "A+"), (1, "B 2", "C+")], "student int, code string, grade string")
    courses = spark.createDataFrame([("A 1", 4), ("B 2", 3)], "code string, units int")
    prior = spark.createDataFrame([(1, 0.0, 0)], "student int, gpa double, units int")
    assert academics.projected_gpa(taken, courses, prior).first().gpa == 3.27 and academics.projected_gpa(taken, courses, prior, simple=True).first().gpa == 3.14


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    from datetime import datetime

    from transferlake.streaming import tasks

    at = lambda day, k: (k, datetime(2024, 1, day), 1, "t", "started")
    schema = "event_id long, ts timestamp, plan long, tool string, state string"
    for n, rows in enumerate([[at(1, 1), at(20, 2)], [at(20, 3)], [at(1, 4), at(20, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run = tasks.windowed_counts(stream).writeStream.outputMode("update").foreachBatch(lambda df, batch, n=n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/run={n}/batch={batch}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    counts = spark.read.parquet(f"{tmp_path}/out").groupBy("window_start").agg(F.max("n").alias("n")).collect()
    assert {r.window_start.day: r.n for r in counts} == {1: 1, 20: 3}


def test_held_out_rows_have_no_copies(spark):
    data = spark.createDataFrame([(i, "ab"[i % 10 == 0], f"Text {i}.") for i in range(200)], "id long, label string, text string")
    got = labels.augmented_split(data, {"b": 3}, 90).collect()
    held, train = {r.id for r in got if r.part == "validation"}, [r for r in got if r.part == "train"]
    assert not held & {r.id for r in train} and len(held) == 30
    counts = {x: sum(r.label == x for r in train) for x in "ab"}
    assert counts == {"a": 153, "b": 90}
    assert all(r.text == f"Text {r.id}." for r in got if r.copy == 0)
    assert all(r.text in (f"text {r.id}.", f"Text {r.id}", f"Text {r.id}x") for r in train if r.copy)


def test_the_classifier_is_better_than_the_most_frequent_label(spark):
    import __spark_entry__

    report = __spark_entry__.queries()["train_classifier"](spark, "/root/testdata/sf0.01").collect()
    rows_ = sum(r.support for r in report)
    most = max(r.support for r in report) / rows_
    assert sum(r.f1 * r.support for r in report) / rows_ > 2 * most / (1 + most) * most + 0.02
