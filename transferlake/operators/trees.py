"""Agreements from their JSON text: flattened rows, inferred logic, requirement trees, and what is read off those.

Every step works within the row of one agreement, so none but the final explode changes the number of rows and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.agreements import ARTICULATION, ASSET

#: Units of a course that states none, marked as estimated.
USUAL_UNITS = 4.0
NONE_ARTICULATED = "No Course Articulated"


def clean(html: Column) -> Column:
    """Text without tags, ``&nbsp;`` a space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", ""), F.lit("&nbsp;"), F.lit(" ")), r"\s+", " "))


def once(value: Column, use) -> Column:
    """use(value), where value is made once however often it is used: it is a lambda's argument there, not a copy of its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _listed(column: str, kind: str) -> Column:
    """A JSON text as a list; bad or missing text is an empty one."""
    return F.coalesce(F.from_json(column, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def parsed(raw: DataFrame) -> DataFrame:
    """(agreement, name, assets, sent): JSON texts parsed a second time; bad or missing text is an empty list.

    assets stand in the order of position, those without one last; sent maps a cell's id to its articulation.
    """
    # The place in the text breaks ties, so that equal positions keep their order.
    placed = F.transform(_listed("templateAssets", ASSET), lambda x, i: F.struct(x["position"].isNull().alias("last"), x["position"].alias("position"), i.alias("i"), x.alias("asset")))
    # A cell that is named twice has its last articulation.
    def last(named: Column) -> Column:
        kept = lambda ids: F.filter(named, lambda x, i: ~F.array_contains(F.slice(ids, i + 2, F.size(ids)), x["templateCellId"]))
        return F.transform(once(F.transform(named, lambda x: x["templateCellId"]), kept), lambda x: F.struct(x["templateCellId"], x["articulation"]))

    named = F.filter(_listed("articulations", ARTICULATION), lambda x: x["templateCellId"].isNotNull())
    return raw.select("agreement", "name", F.transform(F.array_sort(placed), lambda x: x["asset"]).alias("assets"), F.map_from_entries(once(named, last)).alias("sent"))


def _groups_in(assets: Column) -> Column:
    """array<struct<group_id, area, recommended, asset>>: the requirement groups, each under the last title above it."""
    is_group = lambda p: p["asset"]["type"] == "RequirementGroup"

    def one(p: Column, k: Column) -> Column:
        above = F.slice(assets, 1, p["i"])
        area = clean(F.try_element_at(F.filter(above, lambda x: x["type"] == "RequirementTitle"), F.lit(-1))["content"])
        behind_title = F.coalesce(F.try_element_at(above, F.lit(-1))["type"] == "RequirementTitle", F.lit(False))
        return once(area, lambda a: F.struct((k + 1).alias("group_id"), a.alias("area"), (behind_title & F.contains(F.upper(a), F.lit("RECOMMENDED"))).alias("recommended"), p["asset"].alias("asset")))

    return F.transform(F.filter(F.transform(assets, lambda x, i: F.struct(i.alias("i"), x.alias("asset"))), is_group), one)


def groups(raw: DataFrame) -> DataFrame:
    """(agreement, name, sent, group_id, area, recommended, asset): a row for each requirement group, under the last title above it."""
    # The outer explode: the other one is given filters on its list, in which the texts would be parsed again.
    rows = parsed(raw).select("agreement", "name", "sent", F.explode_outer(_groups_in(F.col("assets"))).alias("g"))
    return rows.where("g is not null").select("agreement", "name", "sent", "g.*")


def course_text(course: Column) -> Column:
    units = F.when(course["units"].isNotNull(), F.concat(F.lit(" ("), F.format_string("%.2f", course["units"]), F.lit(" units)"))).otherwise("")
    return F.concat(F.trim(course["prefix"]), F.lit(" "), F.trim(course["courseNumber"]), F.lit(": "), F.trim(course["courseTitle"]), units)


def receiving_text(cell: Column) -> Column:
    """The course or the courses of a series, behind the cell's notes."""
    series = F.call_function("array_join", F.transform(cell["series"]["courses"], course_text), F.concat(F.lit(" "), F.upper(F.coalesce(cell["series"]["conjunction"], F.lit("And"))), F.lit(" ")))
    return F.concat(notes(cell["attributes"], "\n"), F.when(cell["type"] == "Series", series).otherwise(course_text(cell["course"])))


def notes(attributes: Column, end: str = "") -> Column:
    """Cleaned notes joined by full stops, with ``end`` behind them; empty without any."""
    joined = F.array_join(F.filter(F.transform(F.coalesce(attributes, F.array().cast("array<struct<content: string>>")), lambda a: clean(a["content"])), lambda t: t != ""), ". ")
    return once(joined, lambda said: F.when(said == "", "").otherwise(F.concat(said, F.lit(end)))) if end else joined


def options_of(articulation: Column) -> Column:
    """array<array<string>>: codes of each option, in the order of position; empty without an articulation."""
    ordered = F.array_sort(articulation["items"])
    codes = F.transform(ordered, lambda g: F.transform(g["items"], lambda c: F.concat_ws(" ", c["prefix"], c["courseNumber"])))
    return F.coalesce(codes, F.array().cast("array<array<string>>"))


def sending_text(articulation: Column) -> Column:
    """Options joined by OR, or the conjunction given, an option of several courses in brackets."""
    one = F.transform(options_of(articulation), lambda o: F.when(F.size(o) > 1, F.concat(F.lit("("), F.array_join(o, " AND "), F.lit(")"))).otherwise(F.array_join(o, "")))
    joined = F.call_function("array_join", one, F.concat(F.lit(" "), F.upper(F.coalesce(articulation["conjunction"], F.lit("Or"))), F.lit(" ")))
    return once(joined, lambda said: F.when(said != "", said).otherwise(F.coalesce(articulation["noArticulationReason"], F.lit(NONE_ARTICULATED))))


def letter(place: Column) -> Column:
    return F.char(F.lit(65) + place)


def cells_of(raw: DataFrame) -> DataFrame:
    """A row for each cell: (agreement, group_id, area, section, cell_no, cell, articulation, asset, part_of)."""
    sections = groups(raw).select("*", F.posexplode_outer("asset.sections").alias("s", "part_of"))
    rows = sections.select("*", F.posexplode_outer("part_of.rows").alias("r", "line")).select("*", F.posexplode_outer("line.cells").alias("c", "cell")).where("cell is not null")
    return rows.select("agreement", "name", "group_id", "area", "recommended", letter(F.col("s")).alias("section"), F.struct("r", "c").alias("cell_no"), "cell", F.try_element_at("sent", F.col("cell.id")).alias("articulation"), "asset", "part_of")


def flatten(raw: DataFrame) -> DataFrame:
    """(agreement, area, group_id, section, cell_id, receiving_text, sending_text); sections without cells give no rows."""
    return cells_of(raw).select("agreement", "area", "group_id", "section", F.col("cell.id").alias("cell_id"), receiving_text(F.col("cell")).alias("receiving_text"), sending_text(F.col("articulation")).alias("sending_text"))


def _first_amount(advisements: Column, wanted) -> Column:
    """The amount, 1 if it has none, of the first advisement that is wanted; null if none is."""
    return F.get(F.transform(F.filter(advisements, wanted), lambda a: F.coalesce(a["amount"], F.lit(1.0)).cast("int")), F.lit(0))


def _logic(kind: str, n: Column | None = None) -> Column:
    return F.named_struct(F.lit("logic_type"), F.lit(kind), F.lit("n"), (F.lit(None) if n is None else n).cast("int"))


def section_logic(section: Column) -> Column:
    """Struct (logic_type, n): so many courses if an advisement says so, one if a series stands beside its own courses or rows are alternatives, else all."""
    said = _first_amount(section["advisements"], lambda a: (a["type"] == "NFollowing") & (a["amountUnitType"] == "Course"))
    in_rows = F.flatten(F.transform(section["rows"], lambda r: r["cells"]))
    code = lambda c: F.concat_ws(" ", c["prefix"], c["courseNumber"])
    series = F.flatten(F.transform(F.filter(in_rows, lambda c: c["type"] == "Series"), lambda c: F.transform(c["series"]["courses"], code)))
    alone = F.transform(F.filter(in_rows, lambda c: c["type"] == "Course"), lambda c: code(c["course"]))
    several = F.size(section["rows"]) > 1
    choice = several & (F.arrays_overlap(series, alone) | F.exists(section["rows"], lambda r: r["conjunction"] == "Or"))
    return once(said, lambda n: F.when(n.isNotNull(), _logic("select_n_courses", n)).when(F.coalesce(choice, F.lit(False)), _logic("select_n_courses", F.lit(1))).otherwise(_logic("all_required")))


def group_logic(asset: Column) -> Column:
    """Struct (logic_type, n): advisements come before those of an only section, those before the instruction, and without any all is required."""
    selects = lambda a: (a["type"] == "NFollowing") & (a["selectionType"] == "Select")
    only = F.when(F.size(asset["sections"]) == 1, F.get(asset["sections"], F.lit(0)))
    n_courses = F.size(F.filter(F.flatten(F.transform(only["rows"], lambda r: r["cells"])), lambda c: c["type"] == "Course"))
    own = F.coalesce(_first_amount(asset["advisements"], selects), _first_amount(only["advisements"], selects), F.when(n_courses >= 2, _first_amount(only["advisements"], lambda a: a["type"] == "NFollowing")))
    said = asset["instruction"]
    amount = F.coalesce(said["amount"].cast("int"), F.lit(1))
    return once(
        own,
        lambda n: F.when(n.isNotNull(), _logic("select_n_courses", n))
        .when(said["type"].isin("NFromArea", "NFromConjunction"), _logic("select_n_courses", amount))
        .when((said["conjunction"] == "Or") & ((said["selectionType"] == "Complete") | ((said["selectionType"] == "Select") & (F.size(asset["sections"]) > 1))), _logic("choose_one_section"))
        .when(said["selectionType"] == "Select", _logic("select_n_courses", amount))
        .otherwise(_logic("all_required")),
    )


def logic(raw: DataFrame) -> DataFrame:
    """(agreement, group_id, section, group_logic, group_n, section_logic, section_n) of every section, with cells or without."""
    own = F.transform("asset.sections", lambda s, i: F.struct(letter(i).alias("section"), section_logic(s).alias("own")))
    rows = groups(raw).select("agreement", "group_id", group_logic(F.col("asset")).alias("g"), F.explode_outer(own).alias("s")).where("s is not null")
    return rows.select("agreement", "group_id", "s.section", F.col("g.logic_type").alias("group_logic"), F.col("g.n").alias("group_n"), F.col("s.own.logic_type").alias("section_logic"), F.col("s.own.n").alias("section_n"))


def _members(cell: Column) -> Column:
    """The courses of a cell: those of its series, or its own."""
    return F.when(cell["type"] == "Series", cell["series"]["courses"]).otherwise(F.array(cell["course"]))


def _codes(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda c: F.concat_ws(" ", c["prefix"], c["courseNumber"])), " + ")


def placed(raw: DataFrame) -> DataFrame:
    """(agreement, r): array<struct<group_id, section_id, place, uc_course, options>>, the requirements of ``trees`` by their place in a section.

    Nothing else of a tree is made: cells and articulations are cut to what is asked before groups are ordered and cells find theirs, as every step copies what it hands on.
    """
    cells = lambda s: F.transform(F.flatten(F.transform(s["rows"], lambda r: r["cells"])), lambda c: F.struct(_codes(_members(c)).alias("uc_course"), c["id"].alias("id")))
    sections = lambda x: F.transform(x["sections"], lambda s: F.coalesce(cells(s), F.array()))
    groups = F.transform(F.filter(_listed("templateAssets", ASSET), lambda x: x["type"] == "RequirementGroup"), lambda x, i: F.struct(x["position"].isNull().alias("last"), x["position"].alias("position"), i.alias("i"), sections(x).alias("sections")))
    named = F.filter(_listed("articulations", ARTICULATION), lambda x: x["templateCellId"].isNotNull())
    cut = raw.select("agreement", F.sort_array(groups).alias("groups"), F.transform(named, lambda x: F.struct(x["templateCellId"].alias("id"), options_of(x["articulation"]).alias("options"))).alias("named"))
    # A cell that is named twice has its last articulation.
    ids = F.transform("named", lambda x: x["id"])
    last = F.filter("named", lambda x, i: ~F.array_contains(F.slice(ids, i + 2, F.size("named")), x["id"]))
    held = cut.select("agreement", "groups", F.map_from_entries(F.when(F.size(F.array_distinct(ids)) == F.size("named"), F.col("named")).otherwise(last)).alias("sent"))
    options = lambda c: F.coalesce(F.try_element_at("sent", c["id"]), F.array().cast("array<array<string>>"))
    at = lambda g, i, c, place: F.struct((g + 1).alias("group_id"), letter(i).alias("section_id"), place.alias("place"), c["uc_course"].alias("uc_course"), options(c).alias("options"))
    group = lambda x, g: F.flatten(F.transform(x["sections"], lambda s, i: F.transform(s, lambda c, place: at(g, i, c, place))))
    return held.select("agreement", F.flatten(F.array_compact(F.transform("groups", group))).alias("r"))


def trees(raw: DataFrame) -> DataFrame:
    """(agreement, name, groups): the requirement tree of each agreement, groups in their order and sections by letter.

    A group is titled after its area, or after its logic where it has none. A group that selects courses says so for its sections. A series is one
    requirement with the units of its courses; a course without units has USUAL_UNITS, marked. An agreement without groups has an empty tree.
    """
    def requirement(cell: Column) -> Column:
        members = _members(cell)
        units = F.aggregate(members, F.lit(0.0), lambda held, c: held + F.coalesce(c["units"], F.lit(USUAL_UNITS)))
        articulation = F.try_element_at("sent", cell["id"])
        return F.struct(
            _codes(members).alias("uc_course_id"),
            F.get(members, F.lit(0))["courseTitle"].alias("uc_course_title"),
            units.alias("units"),
            F.exists(members, lambda c: c["units"].isNull()).alias("units_estimated"),
            notes(cell["attributes"]).alias("note"),
            notes(articulation["attributes"]).alias("sending_note"),
            options_of(articulation).alias("options"),
        )

    def held(asset: Column, g: Column) -> Column:
        own = lambda s: F.when(g["logic_type"] == "select_n_courses", g).otherwise(section_logic(s))
        sections = F.transform(asset["sections"], lambda s, i: F.struct(letter(i).alias("section_id"), own(s).alias("logic"), F.transform(F.flatten(F.transform(s["rows"], lambda r: r["cells"])), requirement).alias("uc_courses")))
        return F.filter(sections, lambda s: F.size(s["uc_courses"]) > 0)

    def one(x: Column, g: Column) -> Column:
        by_logic = F.when(g["logic_type"] == "choose_one_section", "Choose one section").when(g["logic_type"] == "select_n_courses", F.concat(F.lit("Select "), g["n"].cast("string"))).otherwise("All required")
        title = F.when(x["area"] != "", x["area"]).otherwise(by_logic)
        return F.struct(x["group_id"].alias("group_id"), title.alias("group_title"), g["logic_type"].alias("group_logic_type"), g["n"].alias("n_courses"), x["recommended"].alias("recommended"), held(x["asset"], g).alias("sections"))

    return parsed(raw).select("agreement", "name", F.transform(_groups_in(F.col("assets")), lambda x: once(group_logic(x["asset"]), lambda g: one(x, g))).alias("groups"))


def requirements_of(tree: DataFrame) -> DataFrame:
    """A row for each requirement of a tree, with its group and section."""
    # Outer explodes, as in groups().
    rows = tree.select("agreement", "name", F.explode_outer("groups").alias("g")).select("agreement", "name", "g", F.explode_outer("g.sections").alias("s")).select("agreement", "name", "g", "s", F.explode_outer("s.uc_courses").alias("c")).where("c is not null")
    return rows.select("agreement", "name", "g.group_id", "g.group_title", "g.group_logic_type", "g.n_courses", "g.recommended", F.col("s.section_id").alias("section_id"), F.col("s.logic.logic_type").alias("section_logic_type"), F.col("s.logic.n").alias("section_n"), "c.*")


def documents(tree: DataFrame) -> DataFrame:
    """A document for each requirement: its text and what is derived from its options."""
    rows = requirements_of(tree)
    none = F.size("options") == 0
    summary = F.array_join(F.transform("options", lambda o, i: F.concat(F.lit("Option "), letter(i), F.lit(": "), F.array_join(o, " + "))), "; ")
    text = F.concat_ws("\n", F.concat_ws(" - ", "uc_course_id", "uc_course_title"), F.concat(F.lit("Group: "), F.col("group_id").cast("string"), F.lit(" | Section: "), F.col("section_id")), F.concat(F.lit("Logic Type: "), F.col("group_logic_type"), F.lit(" | N Required: "), F.coalesce(F.col("n_courses").cast("string"), F.lit("N/A"))))
    return rows.select(
        "agreement",
        "group_id",
        "section_id",
        F.col("uc_course_id").alias("uc_course"),
        none.alias("no_articulation"),
        F.coalesce(F.array_max(F.transform("options", F.size)), F.lit(0)).alias("course_count"),
        F.exists("options", lambda o: F.size(o) > 1).alias("multi_course_option"),
        F.when(none, "No articulated course.").otherwise(summary).alias("options_summary"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten("options"))), ", ").alias("ccc_courses"),
        text.alias("text"),
    )


def group_summary(tree: DataFrame) -> DataFrame:
    """(agreement, group_id, summary, courses): sections with their courses and options, a line each, and all sending courses."""
    rows = tree.select("agreement", F.explode_outer("groups").alias("g"))
    options = lambda c: F.when(F.size(c["options"]) == 0, NONE_ARTICULATED).otherwise(F.array_join(F.transform(c["options"], lambda o: F.array_join(o, " + ")), " or "))
    line = lambda s: F.concat(F.lit("Section "), s["section_id"], F.lit(": "), F.array_join(F.transform(s["uc_courses"], lambda c: F.concat(c["uc_course_id"], F.lit(" <- "), options(c))), "; "))
    sent = F.flatten(F.flatten(F.transform("g.sections", lambda s: F.transform(s["uc_courses"], lambda c: F.flatten(c["options"])))))
    return rows.where(F.size("g.sections") > 0).select("agreement", "g.group_id", F.array_join(F.transform("g.sections", line), "\n").alias("summary"), F.array_join(F.array_sort(F.array_distinct(sent)), ", ").alias("courses"))


def notes_extract(tree: DataFrame) -> DataFrame:
    """(agreement, side, group_id, section_id, uc_course, note): notes of receiving and of sending courses, where there are any."""
    rows = requirements_of(tree).select("agreement", "group_id", "section_id", F.col("uc_course_id").alias("uc_course"), F.explode(F.array(F.struct(F.lit("receiving").alias("side"), F.col("note")), F.struct(F.lit("sending").alias("side"), F.col("sending_note").alias("note")))).alias("x"))
    return rows.where("x.note <> ''").select("agreement", "x.side", "group_id", "section_id", "uc_course", "x.note")


TREE = "struct<major: string, groups: array<struct<group_id: int, group_title: string, sections: array<struct<section_id: string, section_logic_type: string, uc_courses: array<struct<uc_course_id: string, uc_course_title: string, logic_block: struct<type: string, courses: array<string>>>>>>>>>"
LOGIC_TYPES = ["AND", "OR"]


def conformance(texts: DataFrame) -> DataFrame:
    """(agreement, place, issue) of texts(agreement, tree), trees as JSON text: a row for each missing field and each unknown logic type."""
    tree = texts.select("agreement", F.from_json("tree", TREE).alias("t"))
    found = lambda place, **rules: F.transform(F.array_compact(F.array(*(F.when(broken, F.lit(name.replace("_", " "))) for name, broken in rules.items()))), lambda issue: F.struct(place.alias("place"), issue.alias("issue")))
    in_block = lambda place, c: found(place, missing_logic_block=c["logic_block"].isNull(), unknown_logic_type=~F.coalesce(c["logic_block"]["type"], F.lit("")).isin(LOGIC_TYPES) & c["logic_block"].isNotNull(), missing_courses=c["logic_block"]["courses"].isNull() & c["logic_block"].isNotNull())
    in_course = lambda place, c: F.concat(found(place, missing_uc_course_id=c["uc_course_id"].isNull(), missing_uc_course_title=c["uc_course_title"].isNull()), in_block(place, c))
    below = lambda place, mark, i: F.concat(place, F.lit(mark), (i + 1).cast("string"))
    in_section = lambda place, s: F.concat(found(place, missing_section_id=s["section_id"].isNull(), missing_section_logic_type=s["section_logic_type"].isNull(), missing_uc_courses=s["uc_courses"].isNull()), F.flatten(F.coalesce(F.transform(s["uc_courses"], lambda c, i: in_course(below(place, ".C", i), c)), F.array())))
    in_group = lambda place, g: F.concat(found(place, missing_group_id=g["group_id"].isNull(), missing_group_title=g["group_title"].isNull(), missing_sections=g["sections"].isNull()), F.flatten(F.coalesce(F.transform(g["sections"], lambda s, i: in_section(below(place, ".S", i), s)), F.array())))
    top = found(F.lit("agreement"), missing_major=F.col("t.major").isNull(), missing_groups=F.col("t.groups").isNull())
    everything = F.concat(top, F.flatten(F.coalesce(F.transform("t.groups", lambda g, i: in_group(F.concat(F.lit("G"), (i + 1).cast("string")), g)), F.array())))
    return tree.select("agreement", F.explode(everything).alias("x")).select("agreement", "x.place", "x.issue")
