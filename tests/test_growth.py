"""What keeps the work of a query in step with its input."""

import json
import math
import random
import re

from pyspark.sql import functions as F

from transferlake.operators import cascade, catalogue, conformance, graph, logic, matching, reports, requirements, search, trees
from transferlake.plans import catalogue as catalogue_queries
from transferlake.plans import logic as logic_queries
from transferlake.plans import queries as engine
from transferlake.plans import reports as report_queries
from transferlake.sources import agreements, catalogues, hard_lines, stand_ins

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_agreement_texts_are_parsed_once_and_never_shuffled(spark):
    raw = agreements.raw_agreements(spark, SF)
    assert "RepartitionByExpression" in optimized(raw)
    given = spark.createDataFrame([(1, "n", "[]", "[]")], "agreement long, name string, templateAssets string, articulations string")
    tree = trees.trees(given)
    for df in (trees.flatten(given), trees.logic(given), trees.documents(tree), trees.notes_extract(tree), trees.group_summary(tree)):
        assert optimized(df).count("from_json") <= 2
        assert "Aggregate" not in optimized(df)


def test_ways_are_made_within_the_row(spark):
    assert "LogicalRDD" not in optimized(logic_queries.logic_ways(spark, SF)) + optimized(logic_queries.logic_ranges(spark, SF))  # nothing was written on the way
    kinds = "agreement long, groups array<struct<group_id: int, group_logic_type: string, n_courses: int, sections: array<struct<logic: struct<logic_type: string, n: int>, uc_courses: array<struct<options: array<array<string>>>>>>>>"
    own = [([["a", "b"], ["a"]],), ([["c"], ["b", "d", "b"]],), ([],), ([["e"], []],)]
    section = lambda n, *of: (("select_n_courses" if n else "all_required", n), [own[i] for i in of])
    made = [[("all_required", None)], [("choose_one_section", None)], [("select_n_courses", 2)], [("select_n_courses", 9)]]
    groups = [(k, kind, n, [section(None, 0, 1), section(1, 1, 2, 3), section(2, 0, 3)][: k % 4]) for k, [(kind, n)] in enumerate(made * 4)]
    tree = spark.createDataFrame([(1, groups), (2, groups), (3, [])], kinds)
    nodes = logic.tree_nodes(tree)
    shown = lambda ways: sorted((r.tree.agreement, r.tree.group_id, [list(w) for w in r.ways]) for r in ways.collect())
    assert shown(logic.tree_ways(tree)) == shown(logic.minimal_ways(nodes))
    requirements = nodes.where("code is not null").select("tree", F.regexp_replace("parent", r"\.\d+$", "").alias("node")).distinct()
    two = nodes.where("need is null and code is null and parent <> '' and tree.agreement = 1").groupBy("tree", F.col("parent").alias("node")).count().where("count = 2")
    ranges = two.join(requirements, ["tree", "node"]).select("tree", "node", F.lit(0).alias("first"), F.lit(1).alias("last"))
    assert shown(logic.tree_ways(tree, F.col("agreement") == 1)) == shown(logic.minimal_ways(logic.with_ranges(nodes, ranges)))


def test_audit_report_writes_nothing_on_the_way(spark):
    assert "LogicalRDD" not in optimized(report_queries.audit_report(spark, SF))


def test_pages_are_cleaned_with_one_sort_of_their_lines_each_way(spark):
    lines = spark.createDataFrame([], "doc_id long, line_no long, line string")
    plan = optimized(catalogue.cleaned(lines))
    assert plan.count("lag(") == 1 and plan.count("row_number") == 0
    assert "transform(" not in optimized(hard_lines.page_lines(spark, SF)) and "transform(" not in optimized(hard_lines.course_lines(spark, SF))
    numbers = [n for page in range(4) for n in ("Title", f"text {page}", f"on {page}", "Foot 7", str(20 + page))]
    got = catalogue.without_furniture(spark.createDataFrame([(1, i, t) for i, t in enumerate(numbers)], lines.schema), least_pages=3).collect()
    assert [r.line for r in sorted(got)] == []  # behind titles and footers the texts, alike but for numbers, are at the ends
    got = catalogue.without_furniture(spark.createDataFrame([(1, i, t) for i, t in enumerate(numbers)], lines.schema), least_pages=5).collect()
    assert [r.line for r in sorted(got)] == [t for t in numbers if not t.isdigit()]


def test_tiers_sort_nothing_by_question(spark):
    docs = spark.createDataFrame([(i, f"C {i % 9}", i % 2, "AB"[i % 4 // 2]) for i in range(40)], "doc int, course string, grp int, section string")
    asked = spark.createDataFrame([(1, 0, "B", "C 1"), (2, 1, "Z", "C 1"), (3, 9, "A", "C 4"), (4, None, None, "C 8"), (5, 7, "A", "no")], "query long, grp int, section string, course string")
    got = matching.tiered(asked, docs, 3)
    assert "windowspecdefinition(query" not in optimized(got)
    shown = {}
    for r in sorted(got.collect(), key=lambda r: (r.query, r["rank"])):
        shown.setdefault((r.query, r.tier), []).append((r["rank"], r.doc))
    lists = {(1, 1): [2, 6, 10], (2, 2): [1, 5, 9], (3, 3): [4, 13, 22], (4, 3): [8, 17, 26]}
    assert shown == {k: list(enumerate(v, 1)) for k, v in lists.items()}


def test_rounds_of_graphs_broadcast_nothing(spark, monkeypatch):
    plans, saved = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: plans.append(optimized(df)) or saved(df))
    edges = spark.createDataFrame([(4, 2), (2, 1), (4, 1)], "course long, needs long")
    assert graph.closure(edges).count() == 3
    assert sorted(map(tuple, graph.levels(spark.range(1, 5).withColumnRenamed("id", "course"), edges).collect())) == [(1, 0), (2, 1), (3, 0), (4, 2)]
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_lists_and_objects_are_not_walked_for_their_types(spark):
    text, number = {"type": ["string", "null"], "minLength": 1, "patterns": ["^a", "b$"]}, {"type": "number", "minimum": 1}
    item = {"type": "object", "properties": {"t": text, "n": number}, "required": ["t"], "additionalProperties": False}
    bare = {"type": "object", "properties": {"l": {"type": ["array", "null"], "minItems": 1, "items": {"type": "object"}}}, "required": ["l"]}
    given = ['{"l": []}', '{"l": null, "x": 1}', '{"l": {}}', '{"l": [{}, [], 1, null, "s"]}', "[]", "null", "{}", "no", None]
    rows = spark.createDataFrame(list(enumerate(given)), "id int, text string")
    df = conformance.conformance(rows, bare, "id")
    assert "schema_of_variant" not in optimized(df).lower().replace("schemaofvariant", "schema_of_variant")
    wrong = [(2, "$.l"), (3, "$.l[1]"), (3, "$.l[2]"), (3, "$.l[3]"), (3, "$.l[4]"), (4, "$"), (5, "$")]
    assert sorted(map(tuple, df.collect())) == sorted([(0, "$.l", "empty list"), (6, "$", "missing l"), (7, "$", "not JSON"), (8, "$", "not JSON"), *((*w, "wrong type") for w in wrong)])
    deep = {"type": "array", "items": item}
    given = '[{"t": "ax", "n": 1}, {"t": " \\t", "n": 0.5}, {"t": "x", "n": 12345678901234567890123}, {"t": null, "n": "1"}, {"n": null, "o": 1}, {"t": 5}, {"t": {"t": 1}}, {"t": "xb"}]'
    got = conformance.conformance(spark.createDataFrame([(1, given)], "id int, text string"), deep, "id").select("place", "issue").collect()
    faults = [("$[1].t", "blank"), ("$[1].n", "out of range"), ("$[2].t", "pattern"), ("$[3].n", "wrong type"), ("$[4]", "missing t"), ("$[4]", "unexpected o"), ("$[4].n", "wrong type"), ("$[5].t", "wrong type"), ("$[6].t", "wrong type"), ("$[1].t", "pattern")]
    assert sorted(map(tuple, got)) == sorted(faults)


def test_questions_of_a_tier_meet_its_first_documents_only(spark, monkeypatch):
    plans, saved = [], cascade.saved
    monkeypatch.setattr(cascade, "saved", lambda df: plans.append(optimized(df)) or saved(df))
    given = [(i, i % 2, "AB"[i % 3 % 2], f"U {i % 4}", [f"c{i % 5}", f"c{i % 7}", None]) for i in range(60, 0, -1)] + [(70, None, None, "U 9", None), (71, None, "A", None, ["c0"]), (72, 5, None, "U 9", ["z"])]
    docs = spark.createDataFrame(given, "doc long, grp long, section string, uc string, ccc array<string>")
    asked = [(1, 0, "A", None, None), (2, 1, "Z", None, None), (3, 9, None, ["U 1", "U 2", "U 1"], ["c6", "c4"]), (4, None, None, ["U 3", "U 9"], ["none"]), (5, None, None, ["U 9"], [None]), (6, None, None, None, ["c6", "c0"]), (7, None, None, ["no"], ["c1"]), (8, None, None, ["U 2"], None), (9, None, None, [None], [None]), (10, 5, "A", None, None)]
    got = cascade.cascade(spark.createDataFrame(asked, "query long, grp long, section string, uc array<string>, ccc array<string>"), docs, lambda q: q.select("query", F.lit(0).cast("long").alias("doc")).limit(0), 3)[0].collect()
    firsts = {}
    for doc, grp, section, uc, ccc in sorted(given):
        firsts.setdefault((uc, grp, section), (doc, grp, section, uc, ccc))

    def answer(grp, section, uc, ccc):
        held = sorted(firsts.values())
        uc, ccc = ({x for x in c or [] if x is not None} if c else set() for c in (uc, ccc))
        both = [d[0] for d in held if d[3] in uc and ccc & set(d[4] or [])]
        tiers = [[d[0] for d in held if None not in (grp, section) and d[1:3] == (grp, section)], [d[0] for d in held if grp is not None and d[1] == grp], both or [d[0] for d in held if d[3] in uc], [d[0] for d in held if ccc & set(d[4] or [])]]
        if ccc and not uc:
            tiers[2] = tiers[3]
        return next(([(t, d) for d in docs[:3]] for t, docs in enumerate(tiers, 1) if docs), [])

    assert sorted((r.query, r.tier, r["rank"], r.doc) for r in got) == [(a[0], t, i, d) for a in asked for i, (t, d) in enumerate(answer(*a[1:]), 1)]
    joined = [p for p in plans if "Join Inner" in p]
    assert joined and all(p.count("dense_rank(doc") >= p.count("Join Inner") for p in joined)


def test_references_are_checked_with_their_rows_made_once(spark):
    plan = optimized(catalogue_queries.reference_check(spark, SF))
    assert plan.count("posexplode") == 1 and "windowspecdefinition" not in plan
    columns = ["doc_id", "code", "title", "units"]
    lines = catalogues.catalogue_lines(spark, SF)
    shown = lambda df: sorted(map(tuple, df.select(columns).collect()))
    assert shown(catalogue.course_headers(lines)) == shown(catalogue.course_blocks(lines))
    rows = [(1, "A 1", "Art"), (1, "A 1", "Law"), (1, "A 2", None), (2, "B", "x"), (2, "B", "x"), (None, "C", "y"), (3, "D", "z"), (4, None, "q"), (5, "E", "Tax"), (6, "F", "one")]
    source = [(1, "the ART of"), (3, None), (4, "Q"), (5, "tax"), (5, "none"), (5, "no"), (None, "y"), (6, "ONE")]
    got = catalogue.reference_check(spark.createDataFrame(rows, "doc_id long, code string, title string"), spark.createDataFrame(source, "doc_id long, text string")).collect()
    expected = {(1, "A 1", "repeated code"), (1, "A 1", "title not in source"), (2, "B", "repeated code"), (2, "B", "no source"), (None, "C", "no source"), (5, "E", "title not in source")}
    assert len(got) == len(expected) and set(map(tuple, got)) == expected


def test_requirements_are_judged_where_a_students_courses_are(spark, monkeypatch):
    dealt_by = lambda df: re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    bare = lambda keys: re.sub(r"#\d+L?", "", keys)
    shown = lambda df: sorted(map(tuple, df.collect()))
    plain = {}
    for rows in (10**9, 100):  # a large table: tasks by its lines, whatever the session's number of partitions
        monkeypatch.setattr(stand_ins, "TASK_ROWS", rows)
        tasks = {str(-(-stand_ins.read(spark, SF, "lineitem").count() // 100))} if rows == 100 else {"4"}
        for query in (engine.group_satisfied, engine.req_partial_best):
            df = query(spark, SF)
            by_student = [n for keys, n in dealt_by(df) if bare(keys) == "student"]
            assert by_student and set(by_student) == tasks
            assert not [keys for keys, _ in dealt_by(df) if "student" in keys and bare(keys) != "student"]
            assert plain.setdefault(query, shown(df)) == shown(df)
    options = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 0, "b"), (1, 1, "c"), (1, 1, "a"), (1, 1, "d"), (2, 0, "a"), (3, 0, "c"), (3, 0, "e"), (3, 1, "c"), (3, 1, "d")], "requirement int, option int, code string")
    taken = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c"), (2, "a"), (3, "z")], "student int, code string")
    got = shown(requirements.best_partial(requirements.option_progress(options, taken), options, taken))
    assert got == [(1, 1, 0, 50.0, "b"), (2, 1, 1, 66.67, "d"), (2, 3, 0, 50.0, "e")]


def test_texts_are_split_once_for_word_scores(spark, monkeypatch):
    plans, saved = [], search.saved
    monkeypatch.setattr(search, "saved", lambda df: plans.append(optimized(df)) or saved(df))
    texts = {1: "A b\tb c", 2: " b  ", 3: "", 4: None, 5: "c c d", 6: "zz"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked = {1: "B c", 2: "none", 3: None, 4: "a D d "}
    _, added = search.impacts(docs, spark.createDataFrame(list(asked.items()), "query_id long, text string"))
    assert [p.count("split(") for p in plans if "doc_id" in p and "split(" in p] == [1]
    words = {i: x.lower().split() for i, x in texts.items() if x is not None}
    mean = sum(map(len, words.values())) / len(words)
    expected = []
    for term in "abcd":
        df = sum(term in w for w in words.values())
        idf = math.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
        expected += [(i, round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean)), 9)) for i, w in words.items() if (tf := w.count(term))]
    assert sorted((r.doc_id, round(r.impact, 9)) for r in added.collect()) == sorted(expected)
    given = spark.createDataFrame([(1, "t", "x")], "doc_id long, title string, text string")
    near = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    plan = optimized(search.hybrid_events(given, spark.createDataFrame([(1, "t")], "query_id long, text string"), near))
    below = plan[: plan.index("Join Inner")] if "Join Inner" in plan else plan
    assert "split(lower(title" in below  # made of the pairs, above their join


def walked(lines):
    """The courses of a document, line by line with the patterns of a line."""
    spark_reads = lambda pattern, line: re.search(pattern, line, re.ASCII)
    out, is_open = [], []
    for line in filter(lambda x: x is not None, lines):
        if found := spark_reads(catalogue.HEADER, line):
            out.append([f"{found[1]} {found[2]}", found[3], float(found[4]), dict.fromkeys([*catalogue.LABELS, "description"])])
            is_open = []
        elif out:
            labels = [n for n, begins in catalogue.LABELS.items() if spark_reads(begins, line)][:1]
            if found := spark_reads(catalogue.COMBINED, line):
                labels = re.split(r"\s*/\s*", found[1].lower())
            mark = any(spark_reads(p, line) for p in ("^[=~]", catalogue.SCHEDULE, catalogue.ARRANGED))
            into = [] if mark else labels or is_open or ["description"]
            body = line
            for begins in [catalogue.COMBINED, *catalogue.LABELS.values()]:
                body = re.sub(begins, "", body, flags=re.ASCII)
            for n in set(into):
                held = out[-1][3][n]
                out[-1][3][n] = body if held is None else held if body in held else f"{held} {body}"
            is_open = into if set(into) & set(catalogue.OPEN_FIELDS) and not spark_reads(r"[.]\s*$", line) else []
    return [(i, *c[:3], *(x or None for x in c[3].values())) for i, c in enumerate(out, 1)]


def test_courses_are_read_in_one_pass_over_lines_in_order(spark):
    plan = optimized(catalogue_queries.parse_hard_courses(spark, SF))
    assert "windowspecdefinition" not in plan and "collect_list" not in plan and "explode" not in plan and "aggregate(" not in plan
    rng = random.Random(7)
    odd = ["Prerequisite: Corequisite: x", "= Transfer: UC", "(Prerequisite/ Advisory /Prerequisite): MATH 1 and", "Transfer: C-ID: é 1.", "Advisory:", "and more ", "ends here. ", "Arrange-2 Hours N Staff", "Prerequisite : no label", "é Formerly MATH 3", "MATH 2 and", "", "  ", "x" * 300, "Cal-GETC Area 4 Formerly", None, "A 1, Art 3 UNITS", "ENGL 1AB, Essays, letters 2.5 UNIT"]
    pool = [*odd, *(line.replace("#", "7") for line in hard_lines.COURSE)]
    docs = {d: rng.choices(pool, k=rng.randrange(0, 60)) for d in [None, *range(60)]}
    rows = [(d, i, line) for d, lines in docs.items() for i, line in enumerate(lines)]
    rng.shuffle(rows)
    expected = sorted(((d, *c) for d, lines in docs.items() for c in walked(lines)), key=str)
    got = catalogue.course_blocks(spark.createDataFrame(rows, "doc_id long, line_no int, line string"))
    assert sorted(map(tuple, got.collect()), key=str) == expected and expected
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # documents and courses that go on in the next batch
    try:
        pieces = [(d, "\n".join(filter(lambda x: x is not None, lines[i : i + 5]))) for d, lines in docs.items() for i in range(0, len(lines), 5)]
        texts = spark.createDataFrame(pieces, "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, catalogue.courses_in(texts).collect()), key=str) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_audit_report_makes_requirements_once(spark):
    assert optimized(report_queries.audit_report(spark, SF)).count("from_json") == 2
    course = lambda n: {"prefix": "U", "courseNumber": str(n)}
    cell = lambda i, n: {"id": i, "type": "Course", "course": course(n)}
    series = {"id": "s", "type": "Series", "series": {"courses": [course(8), course(9)]}}
    group = lambda position, *sections: {"position": position, "type": "RequirementGroup", "sections": [{"rows": [{"cells": cells} for cells in rows]} for rows in sections]}
    sent = lambda i, *options: {"templateCellId": i, "articulation": {"items": [{"position": p, "items": [{"prefix": "S", "courseNumber": c} for c in codes]} for p, codes in options]}}
    assets = [group(5, [[cell("a", 1)], [cell("b", 2), series]], [[]], [[cell("c", 3)]]), {"position": 1, "type": "RequirementTitle", "content": "<b>t</b>"}, group(None, [[cell("a", 4)]]), group(2, [[None, cell(None, 5)]]), group(2, [[cell("d", 6)]]), {"type": "RequirementGroup"}, group(3)]
    found = [sent("a", (1, "xy"), (0, "z")), sent("b"), sent("c", (0, "q")), sent("a", (0, "w")), {"templateCellId": "d"}, sent(None, (0, "n")), sent("s", (0, "s"))]
    texts = [(1, json.dumps(assets), json.dumps(found)), (2, json.dumps(assets), "[]"), (3, "no", None), (4, "[]", json.dumps(found)), (5, json.dumps(assets[:1]), json.dumps(found[1:3]))]
    raw = spark.createDataFrame([(a, "n", x, y) for a, x, y in texts], "agreement long, name string, templateAssets string, articulations string")
    tree = trees.trees(raw).select("agreement", F.explode("groups").alias("g")).select("agreement", "g.group_id", F.explode("g.sections").alias("s"))
    expected = tree.select("agreement", "group_id", "s.section_id", F.posexplode("s.uc_courses").alias("place", "c")).select("agreement", "group_id", "section_id", "place", "c.uc_course_id", "c.options")
    got = trees.placed(raw).select("agreement", F.explode("r").alias("r")).select("agreement", "r.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect())) and got.where("uc_course = 'U 8 + U 9'").count() == 3


def test_audit_report_of_repeated_agreements_is_that_of_their_requirements(spark):
    rows = [(1, 1, 1, "A", 0, "U", [["a"], ["b", None], []]), (1, 1, 1, "A", 1, "V", [["a", "a"]]), (1, None, 1, "A", 0, "W", [["AP 1"]]), (2, 1, 1, "A", 0, "X", None), (None, 1, 1, "B", 0, "Y", [[None], ["a"]])]
    kinds = "group_id: int, section_id: string, place: int, uc_course: string, options: array<array<string>>"
    targets = spark.createDataFrame(rows, "student long, agreement long, " + kinds.replace(": ", " "))
    taken = spark.createDataFrame([(1, "a"), (1, "AP 1"), (None, "a"), (3, "IB"), (2, None)], "student long, code string")
    expected = sorted(map(str, reports.audit_report(targets, taken).collect()))
    per = spark.createDataFrame([(s, a, [tuple(r) for s2, a2, *r in rows if (s2, a2) == (s, a)]) for s, a, *_ in rows], f"student long, agreement long, r array<struct<{kinds}>>")
    assert sorted(map(str, reports.audit_of(per, taken).collect())) == expected and len(expected) == len(rows)
