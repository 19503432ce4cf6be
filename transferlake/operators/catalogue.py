"""Catalogue text: cleaned lines, segments, courses with their labelled fields, schedules and general-education lists.

Lines stand in the order of line_no within doc_id; every window is within one document.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.parsing import AREA
from .lines import in_order

#: Labels of fields and how their lines begin, in the order in which they are tried.
LABELS = {
    "transfer": r"^\W*Transfer:\s*",
    "c_id": r"^\W*C-ID:\s*",
    "ge_area": r"^\W*Cal-GETC Area\s*",
    "prerequisite": r"^\W*Prerequisite:\s*",
    "corequisite": r"^\W*Corequisite:\s*",
    "advisory": r"^\W*Advisory:\s*",
    "formerly": r"^\W*Formerly\s*",
}
HEADER = r"^([A-Z][A-Z ]*?) (\d+[A-Z]{0,2}), (.+?) (\d+(?:\.\d+)?) UNITS?$"
SCHEDULE = r"^(\d{1,2}:\d{2}[ap]\.m\.-\d{1,2}:\d{2}[ap]\.m\.)\s+((?:Th|[MTWRFSU])+)\s+(.+)$"
ARRANGED = r"^(Arrange-[\d.]+ Hours?)\s+(?:N\s+)?(.+)$"
COURSE_CODE = r"^[A-Z][A-Z ]*\d+[A-Z]?$"


# Words that pages split, as they stand at the end of a line and the beginning of the next.
SPLIT_WORDS = {
    "measure-": "ment",
    "invest-": "ment",
    "develop-": "ment",
    "manage-": "ment",
    "require-": "ment",
    "depart-": "ment",
    "educa-": "tional",
    "informa-": "tion",
    "administra-": "tion",
}
#: A line of capitals and spaces only is a caption set vertically.
CAPTION = r"^[A-Z\s]{10,}$"


def without_furniture(lines: DataFrame, first_page: int = 13, last_page: int = 103, least_pages: int = 3) -> DataFrame:
    """(doc_id, line_no, line): lines without what pages add to a text, spaces collapsed.

    A number of one to three digits alone on a line, from ``first_page`` to ``last_page``, ends a page and goes. A first or last line of a page goes if the same line, whatever its numbers, stands there on ``least_pages`` pages of the
    document or more; after it the next one is looked at, up to two lines at either end. Captions in capitals, also those of single letters below each other, go, and so do lines of two characters or fewer that are no number.
    """
    bare = lines.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    number = F.when(F.col("line").rlike(r"^\d{1,3}$"), F.col("line").cast("int"))
    ends = F.coalesce(number.between(first_page, last_page), F.lit(False))
    short = (F.length("line") <= 2) & ~F.col("line").rlike(r"^\d+$")
    # What goes is marked and left out behind the window: a filter before it would clean the line again for each of its tests.
    marked = bare.withColumn("ends", ends).withColumn("gone", short | F.col("line").rlike(CAPTION))
    paged = marked.withColumn("page", F.count_if("ends").over(in_order().rowsBetween(Window.unboundedPreceding, -1))).where("not ends and not gone")
    # A row a page from here on, so that its ends are looked at without sorting the lines again.
    pages = paged.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    key = lambda place: F.regexp_replace(F.element_at("l", place)["line"], r"\d+", "#")
    recurs = lambda edge: (F.count("*").over(Window.partitionBy("doc_id", edge)) >= least_pages).cast("int")
    for _ in range(2):
        seen = pages.withColumn("head", key(1)).withColumn("foot", key(-1)).withColumn("top", recurs("head")).withColumn("bottom", recurs("foot"))
        left = F.slice("l", F.col("top") + 1, F.greatest(F.size("l") - F.col("top") - F.col("bottom"), F.lit(0)))
        pages = seen.where(F.size("l") > F.col("top") + F.col("bottom")).select("doc_id", "page", left.alias("l"))
    return pages.select("doc_id", F.explode_outer("l").alias("x")).select("doc_id", "x.line_no", "x.line")


def cleaned(lines: DataFrame, first_page: int = 13, last_page: int = 103, least_pages: int = 3) -> DataFrame:
    """(doc_id, first_line, n, text): lines without page furniture (``without_furniture``), words that a page splits joined again, and lines that go on merged.

    A line goes on if it begins in lower case, has fewer than eight words and the one before does not end with ``.`` or ``:``.
    """
    bare = without_furniture(lines, first_page, last_page, least_pages)
    before = F.col("before")
    split = F.lit(False)
    for first, second in SPLIT_WORDS.items():
        split = split | (F.endswith(before, F.lit(first)) & F.startswith(F.col("line"), F.lit(second)))
    split = F.coalesce(split, F.lit(False))
    goes_on = F.col("line").rlike(r"^\p{Ll}") & ~before.rlike(r"[.:]$") & (F.size(F.split("line", " ")) < 8)
    joins = split | F.coalesce(goes_on, F.lit(False))
    runs = bare.withColumn("before", F.lag("line").over(in_order())).withColumn("split", split).withColumn("joins", joins).withColumn("run", F.count_if(~F.col("joins")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "split", "line")))
    joined = F.aggregate(parts, F.lit(""), lambda held, x: F.when(held == "", x["line"]).when(x["split"], F.concat(F.regexp_replace(held, "-$", ""), x["line"])).otherwise(F.concat_ws(" ", held, x["line"])))
    return runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n"), joined.alias("text")).drop("run")


def segments(lines: DataFrame) -> DataFrame:
    """(doc_id, segment, title, under, n_lines): a line of ``=`` marks around a title begins a segment, ``~ under X.`` names where it belongs."""
    title = F.nullif(F.regexp_extract("line", r"^=+\s*(.*?)\s*=+$", 1), F.lit(""))
    marked = lines.withColumn("title", title).withColumn("under", F.nullif(F.regexp_extract("line", r"^~.*\bunder\s+(.+?)\.\s*$", 1), F.lit("")))
    numbered = marked.withColumn("segment", F.count("title").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("segment > 0").groupBy("doc_id", "segment").agg(F.max("title").alias("title"), F.max("under").alias("under"), F.count("*").alias("n_lines"))


#: Fields that go on in the next line until one ends in a full stop.
OPEN_FIELDS = ["prerequisite", "corequisite", "advisory"]
#: Several of them at once, parted by slashes.
COMBINED = r"^\W*((?:Prerequisite|Corequisite|Advisory)(?:\s*/\s*(?:Prerequisite|Corequisite|Advisory))+):\s*"


FIELDS = [*LABELS, "description"]
#: Lines up to this length are known again without being matched anew, the latest ``KNOWN_LINES`` of a worker.
KNOWN_LENGTH, KNOWN_LINES = 200, 1 << 16


def _compiled(pattern: str) -> re.Pattern:
    """A pattern that begins with ``^``, as Spark reads it: letters and spaces of ASCII, and its line ends."""
    dot, end = r"[^\n\r\u0085\u2028\u2029]", r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"
    return re.compile(pattern.replace(".+", dot + "+").replace("$", end), re.ASCII)


_WORDS = {begins.removeprefix(r"^\W*").removesuffix(r"\s*"): name for name, begins in LABELS.items()}
_HEADER, _STOP = _compiled(HEADER), _compiled(r"[.]\s*$")
_MARK = re.sub(r"(?<!\\)\((?!\?)", "(?:", f"^[=~]|{SCHEDULE}|{ARRANGED}")
#: A mark or schedule, or a label: labels begin with a line's first word, so that one of them at most is there.
_KNOWN = _compiled(rf"({_MARK})|^\W*(?:({'|'.join(_WORDS)})|{COMBINED.removeprefix(r'^\W*').removesuffix(r'\s*')})\s*")
#: What goes before the text of a labelled line: each label once at most, in the order in which they are tried.
_BEFORE = _compiled("^" + "".join(f"(?:{begins.removeprefix('^')})?" for begins in [COMBINED, *LABELS.values()]))
_OPENING = {FIELDS.index(name) for name in OPEN_FIELDS}


@functools.lru_cache(1 << 10)
def _of_label(words: str) -> tuple:
    """The numbers of a label's fields, and whether they go on in the next line."""
    own = (FIELDS.index(_WORDS[words]),) if words in _WORDS else tuple(dict.fromkeys(FIELDS.index(name) for name in re.split(r"\s*/\s*", words.lower())))
    return own, not _OPENING.isdisjoint(own)


@functools.lru_cache(KNOWN_LINES)
def _of_line(line: str) -> tuple:
    """What a line is by itself: the numbers of its fields, none for a mark and null without a label; its text; whether it opens them and whether it ends in a full stop; (code, title, units) of a header."""
    if "A" <= line[:1] <= "Z" and (found := _HEADER.match(line)):
        code, number, title, units = found.groups()
        return None, line, False, False, (f"{code} {number}", title, float(units))
    stops = line[-1:] == "." or ("." in line and _STOP.search(line) is not None)
    if not (found := _KNOWN.match(line)):
        return None, line, False, stops, None
    mark, label, several = found.groups()
    if mark is not None:
        return (), line, False, False, None
    own, opens = _of_label(label or several)
    body = line[found.end() :]
    if _KNOWN.match(body):
        body = line[_BEFORE.match(line).end() :]
    return own, body, opens and not stops, stops, None


def _courses_of(lines: Iterable[str], held: list | None, n: int) -> Iterator[list]:
    """[number, code, title, units, fields.., what is open] of each course, by the rules of ``course_blocks``; the last of them may go on. held is the course that goes on in the lines, n its number."""
    for line in lines:
        own, body, opens, stops, header = _of_line(line) if len(line) <= KNOWN_LENGTH else _of_line.__wrapped__(line)
        if own is None:
            if header:
                if held:
                    yield held
                n += 1
                held = [n, *header, *_NOTHING]
                continue
            if not held:
                continue
            own = held[-1]
            if not own:
                own = _DESCRIPTION
            elif stops:
                held[-1] = ()
        elif held:
            held[-1] = own if opens else ()
        else:
            continue
        for k in own:
            text = held[k + 4]
            if text is None:
                held[k + 4] = body
            elif body not in text:
                held[k + 4] = f"{text} {body}"
    if held:
        yield held


_DESCRIPTION, _NOTHING = (FIELDS.index("description"),), [*[None] * len(FIELDS), ()]


def _in_header(line: str) -> list[Column]:
    """The code, title and units of a header line."""
    part = lambda k: F.regexp_extract(line, HEADER, k)
    return [F.concat_ws(" ", part(1), part(2)).alias("code"), part(3).alias("title"), part(4).cast("double").alias("units")]


def course_headers(lines: DataFrame) -> DataFrame:
    """(doc_id, code, title, units) of the courses of ``course_blocks``: each has one header, so no other line is dealt or sorted."""
    return lines.where(F.col("line").rlike(HEADER)).select("doc_id", *_in_header("line"))


def course_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, course_no, code, title, units, labels.., description): a header line begins a course, and labelled lines its fields.

    The lines of a course are read from first to last. A labelled line opens its field, or its fields where labels are combined. Where a prerequisite, corequisite or advisory is open and its text so far does not end in a full stop, a
    line without a label goes on with it, over any number of lines; other such lines are the description. Schedules and marks belong to no field and close what is open. What a field gets is appended, unless the field
    holds it already.
    """
    return _read(lines.select("doc_id", "line_no", F.col("line").alias("text")).repartition("doc_id").sortWithinPartitions("doc_id", "line_no"), False)


def courses_in(texts: DataFrame) -> DataFrame:
    """``course_blocks`` of texts(doc_id, text), lines parted by ``\\n``. The texts of a document stand in their order in one partition, so that no line is dealt or sorted."""
    return _read(texts, True)


def _read(texts: DataFrame, parted: bool) -> DataFrame:
    """The courses of texts in order. What is held is the course that is read, whatever the length of a document."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    kinds = {"course_no": pa.int64(), "code": pa.string(), "title": pa.string(), "units": pa.float64(), **dict.fromkeys(FIELDS, pa.string())}

    def made(docs, found, of):
        values = [*zip(*found)][: len(kinds)] if found else [[] for _ in kinds]
        columns = [pa.array([x or None for x in v] if name in FIELDS else v, kind) for (name, kind), v in zip(kinds.items(), values)]
        return pa.RecordBatch.from_arrays([pa.array(docs, of), *columns], names=["doc_id", *kinds])

    def run(batches):
        doc, held, of = None, None, None
        for batch in batches:
            of, docs, found = batch.column("doc_id").type, [], []
            for here, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if held and here != doc:
                    docs.append(doc)
                    found.append(held)
                    held = None
                doc = here
                if text is not None:
                    *ended, held = [*_courses_of(text.split("\n") if parted else (text,), held, held[0] if held else 0)] or [None]
                    docs += [doc] * len(ended)
                    found += ended
            yield made(docs, found, of)
        if held:
            yield made([doc], [held], of)

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, course_no long, code string, title string, units double, {', '.join(f'{n} string' for n in FIELDS)}")


def schedules(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, time, days, location, instructor) of lines that are schedules; hours to arrange have day N.

    A location is in capitals and figures, an instructor is not: the last capitalised word with small letters, and what follows it, is the instructor. Without a location it
    is TBA.
    """
    line = F.col("line")
    fixed, arranged = line.rlike(SCHEDULE), line.rlike(ARRANGED)
    rest = F.when(fixed, F.regexp_extract("line", SCHEDULE, 3)).otherwise(F.regexp_extract("line", ARRANGED, 2))
    split = r"^(.*?)\s*((?:[A-Z][A-Za-z'-]*[a-z][A-Za-z'-]*)(?:\s+[A-Z][A-Za-z'-]*)*)\s*$"
    rows = lines.where(fixed | arranged).select("doc_id", "line_no", F.when(fixed, F.regexp_extract("line", SCHEDULE, 1)).otherwise(F.regexp_extract("line", ARRANGED, 1)).alias("time"), F.when(fixed, F.regexp_extract("line", SCHEDULE, 2)).otherwise("N").alias("days"), rest.alias("rest"))
    return rows.select("doc_id", "line_no", "time", "days", F.coalesce(F.nullif(F.regexp_extract("rest", split, 1), F.lit("")), F.when(F.col("rest").rlike(split), "TBA"), F.col("rest")).alias("location"), F.nullif(F.regexp_extract("rest", split, 2), F.lit("")).alias("instructor"))


def education_courses(lines: DataFrame, year: int, month: int) -> DataFrame:
    """(doc_id, course_no, code, title, units, areas, approved, removed, active, notes): tab-parted rows, with the rows and notes that go on below them.

    Areas and terms are known by their form, wherever they stand. A course is active that was not removed, or will be after the month given.
    """
    parts = F.split("line", "\t")
    note = F.nullif(F.regexp_extract("line", r"^\s*((?:Same as|Formerly):.*)$", 1), F.lit(""))
    known = lines.withColumn("parts", parts).withColumn("is_course", F.get(parts, F.lit(0)).rlike(COURSE_CODE) & (F.size(parts) > 1))
    owned = known.withColumn("course_no", F.count_if("is_course").over(in_order().rowsBetween(Window.unboundedPreceding, 0))).where("course_no > 0")
    behind = F.when(F.col("is_course"), F.slice("parts", 4, 100)).otherwise(F.col("parts"))
    areas = F.filter(F.flatten(F.transform(behind, lambda p: F.split(p, r"\s+"))), lambda a: a.rlike(AREA))
    terms = F.filter(F.transform(behind, lambda p: F.trim(p)), lambda p: p.rlike(r"^(F|S|Su|W)\d{4}$"))
    rows = owned.select("doc_id", "course_no", "line_no", "is_course", "parts", areas.alias("areas"), terms.alias("terms"), note.alias("note"))
    each = rows.select("doc_id", "course_no", F.struct("line_no", "is_course", "parts", "areas", "terms", "note").alias("x"))
    per = each.groupBy("doc_id", "course_no").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.element_at("x", 1)
    dated = F.flatten(F.transform("x", lambda x: F.transform(x["areas"], lambda a: F.concat_ws(" ", a, F.get(x["terms"], F.lit(0))))))
    removed = F.get(head["terms"], F.lit(1))
    return per.select(
        "doc_id",
        "course_no",
        head["parts"][0].alias("code"),
        head["parts"][1].alias("title"),
        F.nullif(F.regexp_extract(F.get(head["parts"], F.lit(2)), r"(\d+\.?\d*)", 1), F.lit("")).cast("double").alias("units"),
        F.array_join(F.array_distinct(dated), ", ").alias("areas"),
        F.get(head["terms"], F.lit(0)).alias("approved"),
        removed.alias("removed"),
        (removed.isNull() | F.coalesce(times.is_future_term(removed, year, month), F.lit(False))).alias("active"),
        F.array_join(F.filter(F.transform("x", lambda x: x["note"]), lambda t: t.isNotNull()), "; ").alias("notes"),
    )


# First parts of compounds, which keep their hyphen, and prefixes that are joined to a longer word that begins with a vowel too.
COMPOUNDS = ["self", "well", "high", "low", "long", "short", "full", "half", "multi", "single", "double"]
PREFIXES = ["pre", "pro", "anti"]
_WORD = r"[\p{L}\p{N}_]"


def without_breaks(text: Column) -> Column:
    """Words that a hyphen breaks are joined: always across a line end; before a space and a small letter only behind more than two characters that are no first part of a
    compound, unless a word of four or more that begins with a vowel follows and they are no prefix that takes one."""
    across = F.regexp_replace(text, rf"({_WORD}+)-\s*\n\s*({_WORD}+)", "$1$2")
    second = rf"([a-z]{_WORD}+)"
    kept = rf"(?!(?i:{'|'.join(COMPOUNDS)})-)"
    joined = rf"(?<!{_WORD})(?:{kept}({_WORD}{{3,}})-\s+(?![aeiou]{_WORD}{{3}}){second}|((?i:{'|'.join(PREFIXES)}))-\s+{second}|({_WORD}+-\s+{second}))"
    return F.regexp_replace(across, joined, "$1$2$3$4$5")  # the last alternative leaves a pair as it is


def reference_check(rows: DataFrame, source: DataFrame) -> DataFrame:
    """(doc_id, code, issue): rows(doc_id, code, title) whose code a document has several times, or whose title its source(doc_id, text) does not hold.

    The rows of a code are gathered once and meet the source once for all issues.
    """
    codes = rows.groupBy("doc_id", "code").agg(F.count("*").alias("n"), F.collect_set(F.lower("title")).alias("titles"))
    met = codes.join(source.select("doc_id", F.lower("text").alias("text"), F.lit(True).alias("there")), "doc_id", "left")
    absent = F.col("there") & F.exists("titles", lambda t: ~F.contains("text", t))
    issues = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated code"), F.when(absent, "title not in source"), F.when(F.col("there").isNull(), "no source")))
    return met.select("doc_id", "code", F.explode_outer(issues).alias("issue")).where("issue is not null").distinct()  # a document may have several sources
