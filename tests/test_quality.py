"""Checks and file readers on small fixtures."""

import pytest

from transferlake.operators import quality
from transferlake.sources import files


def test_notes_merge_where_the_one_before_is_open(spark):
    texts = ["Bring a pen and", "a lens.", "Meets in Santa", "Monica today.", "This is new.", "no mark", "goes here", "The end"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")
    got = [r.text for r in quality.merge_notes(rows).orderBy("first_line").collect()]
    assert got == ["Bring a pen and a lens.", "Meets in Santa Monica today.", "This is new.", "no mark goes here", "The end"]


def test_plain_course_does_not_match_honors(spark):
    members = spark.createDataFrame([(1, 0, "MATH 1H", True), (1, 1, "MATH 2", False), (2, 0, "MATH 1", False), (2, 0, "ART 2", False)], "requirement int, option int, code string, honors boolean")
    codes = spark.createDataFrame([("MATH 1",), ("math 1h",), ("MATH 2",), ("MATH 9",)], "code string")
    got = {(r.code, r.requirement): (r.satisfied, r.lacking) for r in quality.single_course_check(codes, members).collect()}
    assert got[("MATH 1", 1)] == (False, "MATH 1H (Honors), MATH 2")
    assert got[("math 1h", 1)] == (True, "") and got[("MATH 2", 1)] == (True, "")
    assert got[("MATH 1", 2)] == (False, "ART 2")
    assert not any(code == "MATH 9" for code, _ in got)


def test_text_rules_tell_empty_from_short(spark):
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "short"), (4, "A fine long description.")], "id int, text string")
    got = {(r.id, r.violation) for r in quality.violations(rows, quality.text_rules(rows.text), "id").collect()}
    assert got == {(1, "empty"), (2, "empty"), (3, "short"), (3, "no capital"), (3, "odd first word")}


def test_jsonl_leaves_out_headers_and_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"_metadata": {"n": 2}}\n{"id": 1, "t": "x"}\n\n{"id": 2,\n{"id": 3}\n')
    assert sorted(files.read_jsonl(spark, str(tmp_path), "id long, t string").collect()) == [(1, "x"), (3, None)]


def test_labelled_file_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label\na,x\na,x\nb,y\n")
    assert files.read_labelled(spark, str(tmp_path), "text string, label string", ["text", "label"]).count() == 2
    with pytest.raises(ValueError):
        files.read_labelled(spark, str(tmp_path), "text string", ["intent"])
