"""Column functions that read facts out of catalogue, agreement, timeline and question texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Breadth area codes, words of student questions, domain terms and degree marks.
AREA = r"^(1[ABC]|2A|3[AB]|4[A-J]?|5[ABC]|6A|7|8[AB])$"
ABBREVIATIONS = {"calc": "calculus", "bio": "biology", "chem": "chemistry", "comp sci": "computer science", "cs": "computer science", "psych": "psychology", "math": "mathematics", "eng": "english", "engr": "engineering", "phys": "physics", "econ": "economics", "poli sci": "political science", "anthro": "anthropology", "socio": "sociology", "phil": "philosophy", "hist": "history", "geo": "geography", "art hist": "art history"}
TYPOS = {"calculas": "calculus", "calculuas": "calculus", "chemisty": "chemistry", "chemestry": "chemistry", "programing": "programming", "programmin": "programming", "psycology": "psychology", "psycholgy": "psychology", "mathmatics": "mathematics", "mathmatic": "mathematics", "engish": "english", "englsh": "english", "buisness": "business", "bussiness": "business", "anthropolgy": "anthropology", "anthopology": "anthropology", "philosphy": "philosophy", "philosofy": "philosophy"}
LEVEL_WORDS = {"intro": "introduction", "basic": "introduction", "beginner": "introduction", "advanced": "advanced", "intermediate": "intermediate", "upper": "advanced", "lower": "introduction"}
LEVELS = ["introduction", "intermediate", "advanced"]
SYNONYMS = {"math": ["mathematics", "calculus", "algebra", "statistics"], "science": ["biology", "chemistry", "physics"], "english": ["composition", "writing", "literature"], "history": ["american history", "world history", "us history"], "art": ["art history", "visual arts", "fine arts"]}
DEGREE = r"(?i)\b(BA|B\.A\.|BS|B\.S\.|Minor|Certificate|AA-T|AS-T)\b"
DEPARTMENT_PREFIXES = {"cse": "CSE:", "ece": "ECE:", "mae": "MAE:", "cogs": "COGS:"}
DEGREE_NAMES = {"bs": "B.S.", "ba": "B.A.", "minor": "(Minor)"}
SMALL_WORDS = ["and", "in", "of", "the"]
# Fixed values too: the patterns of courses, units and sections.
COURSE_TEXT = r"(?i)([A-Z]{2,}\s?\d+[A-Z]?)\s*:\s*(.*?)\s*\((\d+(?:\.\d+)?)\s*units?\)"
UNITS_TEXT = r"(?i)\((\d+(?:\.\d+)?)\s*units?\)"
SAME_COURSE = r"[A-Z]+(?:\s+[A-Z]+)*\s+[A-Z]*\d+[A-Z]*"
#: What makes a line a section line, and what makes it an address or a span of years.
SECTION_MARKS = r"\d{1,2}:\d{2}[ap]\.m\.|Arrange|[MTWRFSU]{1,7}\s|ONLINE|TBA"
NO_SECTION = r"^\d{4}\s+[A-Z][a-z]+\s+(Street|Avenue|Boulevard|Drive|Road|Lane)|^\d{4}\s*-\s*\d{4}|^\d{4}\s+to\s+\d{4}"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or if it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _looked_up(word: Column, names: dict[str, str]) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(pairs[word], word)


def course_text(text: Column) -> Column:
    """Struct (code, title, units) of ``CODE: Title (N units)``; where that fails, the units alone."""
    clean = _spaced(text)
    units = F.coalesce(_group(clean, COURSE_TEXT, 3), _group(clean, UNITS_TEXT)).cast("double")
    return F.struct(_group(clean, COURSE_TEXT, 1).alias("code"), _group(clean, COURSE_TEXT, 2).alias("title"), units.alias("units"))


def degree_type(text: Column) -> Column:
    """The first degree mark, in upper case."""
    return F.upper(_group(text, DEGREE))


def subject_prefix(code: Column) -> Column:
    return _group(code, r"^([A-Z][A-Z ]*?)\s*\d")


def domain_keywords(text: Column, words: list[str]) -> Column:
    """Those of ``words`` that occur in the text, case aside, sorted."""
    low = F.lower(text)
    return F.filter(F.array(*map(F.lit, sorted(words))), lambda w: F.contains(low, F.lower(w)))


def completeness(*fields: str) -> Column:
    """Share of text fields that are neither null nor empty, two decimals."""
    filled = [F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields]
    return F.round(sum(filled[1:], filled[0]) / len(fields), 2)


def ge_areas(text: Column) -> Column:
    """Breadth area codes among the words of a text."""
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w.rlike(AREA))


def event_dates(text: Column, year: int) -> Column:
    """Struct (starts, ends) of ``July 15``, ``By July 15``, ``May 1 - June 2``, ``May 1 to June 2`` or ``October``.

    A month stands for all its days. Unknown texts give nulls; the year is the caller's.
    """
    clean = F.regexp_replace(F.trim(text), r"(?i)^By\s+", "")
    day = lambda t: F.to_date(F.try_to_timestamp(F.concat(t, F.lit(f" {year}")), F.lit("MMMM d yyyy")))
    sides = F.split(clean, r"\s+(?:-|to)\s+", 2)
    first, last = day(F.get(sides, F.lit(0))), day(F.get(sides, F.lit(1)))
    month = day(F.concat(clean, F.lit(" 1")))
    starts = F.when(F.size(sides) == 2, first).otherwise(F.coalesce(first, month))
    ends = F.when(F.size(sides) == 2, last).otherwise(F.coalesce(first, F.last_day(month)))
    return F.struct(starts.alias("starts"), ends.alias("ends"))


def clean_query(text: Column) -> Column:
    """A question in lower case: typing errors mended, abbreviations written out (longest first), level words made one."""
    words = lambda t, names: F.array_join(F.transform(F.split(t, r"\s+"), lambda w: _looked_up(w, names)), " ")
    out = words(F.trim(F.lower(text)), TYPOS)
    for short in sorted(ABBREVIATIONS, key=len, reverse=True):
        out = F.regexp_replace(out, rf"\b{short}\b", ABBREVIATIONS[short])
    return F.trim(words(out, LEVEL_WORDS))


def query_variants(query: Column) -> Column:
    """The query, then one variant for each synonym of a subject in it, then it without level words; each once."""
    swapped = [F.when(F.contains(query, F.lit(s)), F.replace(query, F.lit(s), F.lit(other))) for s, others in SYNONYMS.items() for other in others]
    bare = F.array_join(F.filter(F.split(query, r"\s+"), lambda w: ~w.isin(LEVELS)), " ")
    unlevelled = F.when(query.rlike("|".join(LEVELS)) & (bare != ""), bare)
    return F.array_distinct(F.array_compact(F.array(query, *swapped, unlevelled)))


def aliases(term: Column, explicit: Column) -> Column:
    """Array of structs (rule, alias, canonical) of a term, in the order in which a later one replaces an earlier one.

    Explicit aliases, a bracketed end of 2 to 10 letters, the two sides of ``A / B``, initials of 2 to 6 words.
    """
    low = F.lower(F.trim(term))
    row = lambda rule, alias, to: F.struct(F.lit(rule).alias("rule"), F.lower(F.trim(alias)).alias("alias"), to.alias("canonical"))
    bracket = F.trim(F.regexp_extract(term, r"\(([^)]+)\)$", 1))
    sides = F.split(term, "/")
    left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    initials = F.array_join(F.transform(F.regexp_extract_all(term, F.lit("([A-Za-z]+)"), F.lit(1)), lambda w: F.substring(w, 1, 1)), "")
    pair = F.size(sides) == 2
    single = F.array(
        F.when(F.length(bracket).between(2, 10), row(2, bracket, low)),
        F.when(pair, row(3, left, F.lower(F.trim(right)))),
        F.when(pair, row(4, right, F.lower(F.trim(left)))),
        F.when(F.length(initials).between(2, 6) & (F.lower(initials) != low), row(5, initials, low)),
    )
    return F.concat(F.transform(explicit, lambda a: row(1, a, low)), F.array_compact(single))


def describe_rating(name: Column, department: Column, rating: Column, difficulty: Column, reviews: Column, again: Column) -> Column:
    """A sentence about a teacher; a clause is there only if its value is known and, except the last, not zero."""
    one = lambda x: F.format_string("%.1f", x)
    clauses = (
        F.concat(F.lit("Professor "), name, F.lit(" teaches in the "), department, F.lit(" department")),
        F.when(rating != 0, F.concat(F.lit("has an average rating of "), one(rating), F.lit("/5.0"))),
        F.when(difficulty != 0, F.concat(F.lit("with a difficulty level of "), one(difficulty), F.lit("/5.0"))),
        F.when(reviews != 0, F.concat(F.lit("based on "), reviews.cast("string"), F.lit(" student reviews"))),
        F.when(again >= 0, F.concat(F.lit("and "), one(again), F.lit("% of students would take their class again"))),
    )
    return F.concat(F.concat_ws(" ", *clauses), F.lit("."))


def name_of_slug(slug: Column) -> Column:
    """``cse_computer_science_bs`` as ``CSE: Computer Science B.S.``, specialisations in brackets, small words in lower case."""
    tail = r"^(.*?)_(with_(?:a|concentration|specialization)(?:_.*)?|secondary_education(?:_.*)?)$"
    head = F.when(slug.rlike(tail), F.regexp_extract(slug, tail, 1)).otherwise(slug)
    rest = F.regexp_extract(slug, tail, 2)
    parts = F.split(head, "_")
    prefixes = F.create_map(*(F.lit(x) for pair in DEPARTMENT_PREFIXES.items() for x in pair))
    prefix = prefixes[F.lower(F.element_at(parts, 1))]
    words = F.when(prefix.isNotNull(), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    named = lambda w: F.when(F.lower(w).isin([*DEGREE_NAMES, *SMALL_WORDS]), _looked_up(F.lower(w), DEGREE_NAMES)).otherwise(F.initcap(w))
    subject = F.regexp_replace(rest, r"^with_(a_)?((concentration|specialization)(_|$))?(in_)?", "")
    kind = F.coalesce(F.initcap(_group(rest, r"^with_(?:a_)?(concentration|specialization)")), F.lit("Specialization"))
    special = F.when(rest.rlike("^secondary"), "(Secondary Education)").when(rest != "", F.concat(F.lit("("), kind, F.lit(" in "), F.initcap(F.replace(subject, F.lit("_"), F.lit(" "))), F.lit(")")))
    return F.concat_ws(" ", prefix, F.array_join(F.transform(words, named), " "), special)


def note_facts(notes: Column) -> Column:
    """Struct (duration, modality) of a section's notes in one text: a stated modality, else the first phrase that tells it."""
    said = F.nullif(_spaced(F.regexp_extract(notes, r"modality is ([^.]+)", 1)), F.lit(""))
    phrase = F.when(notes.rlike(r"(?i)is a hybrid class"), "Hybrid").when(notes.rlike(r"(?i)is an? online class"), "Online").when(notes.rlike(r"(?i)hybrid class taught|taught on campus and online"), "Hybrid").when(notes.rlike(r"(?i)fully on ground|taught in person"), "On Ground")
    return F.struct(_group(notes, r"meets for (\d+ weeks, .+?)(?:\.|,\s*(?:and|at))").alias("duration"), F.coalesce(said, phrase).alias("modality"))


def same_course(description: Column) -> Column:
    """Struct (same_as, description): the other code of ``X is the same course as Y``, and the text before that."""
    sentence = rf"({SAME_COURSE})\s+is the same (?:(?:course|class) )?as\s+({SAME_COURSE})"
    before = F.trim(F.regexp_replace(description, rf"(?s){sentence}.*", ""))
    return F.struct(_group(description, sentence, 2).alias("same_as"), F.nullif(before, F.lit("")).alias("description"))


def section_line(number: Column, rest: Column) -> Column:
    """Why a line with a four-digit start is no section line; null if it is one."""
    whole = F.concat(number, F.lit(" "), rest)
    return F.when(rest.rlike(SECTION_MARKS), None).when(whole.rlike(NO_SECTION), "address or years").otherwise("no schedule")


def section_letter(attribute: Column, position: Column) -> Column:
    """A section's letter: its attribute, else the letter of its position from 0."""
    return F.coalesce(F.nullif(F.trim(attribute), F.lit("")), F.char(65 + position))


def group_title(logic: Column, n: Column, letter: Column) -> Column:
    return (
        F.when(logic == "all_required", F.concat(F.lit("Group "), letter, F.lit(": all required")))
        .when(logic == "select_n_courses", F.concat(F.lit("Group "), letter, F.lit(": select "), n.cast("string"), F.when(n == 1, " course").otherwise(" courses")))
        .otherwise(F.concat(F.lit("Group "), letter, F.lit(": choose one section")))
    )


def notes_text(*notes: Column) -> Column:
    """Notes that are there, joined by semicolons."""
    return F.nullif(F.concat_ws("; ", *(F.nullif(F.trim(n), F.lit("")) for n in notes)), F.lit(""))


# What a bracket speaks of that names no course to take.
ASIDES = ["same as", "within", "placement", "permission", "department consent"]
#: A bracket, a slash, the word or, other text.
PARTS = r"(?i)[()/]|(?<!\p{L})or(?!\p{L})|[^()/oO]+|[oO]"


def without_asides(text: Column) -> Column:
    """The text without brackets that speak of consent, placement and the like. A stack of open brackets decides on each by its own content, after those within it; one that is never closed stays."""
    said = lambda content: F.exists(F.array(*map(F.lit, ASIDES)), lambda a: F.contains(F.lower(content), a))
    rest = lambda held, n: F.slice(held, 1, F.size(held) - n)

    def step(held: Column, part: Column) -> Column:
        top, below = F.element_at(held, -1), F.try_element_at(held, F.lit(-2))
        closed = F.concat(rest(held, 2), F.array(F.when(said(top), below).otherwise(F.concat(below, F.lit("("), top, F.lit(")")))))
        return F.when(part == "(", F.concat(held, F.array(F.lit("")))).when((part == ")") & (F.size(held) > 1), closed).otherwise(F.concat(rest(held, 1), F.array(F.concat(top, part))))

    return F.array_join(F.aggregate(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), F.array(F.lit("")), step), "(")


def alternatives(text: Column) -> Column:
    """The text's parts between the words or and the slashes that stand in no bracket, trimmed; empty ones are left out."""
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit("")).alias("parts"))

    def step(held: Column, part: Column) -> Column:
        depth = F.when(part == "(", held["depth"] + 1).when(part == ")", F.greatest(held["depth"] - 1, F.lit(0))).otherwise(held["depth"])
        splits = (held["depth"] == 0) & ((part == "/") | (F.lower(part) == "or"))
        longer = F.concat(F.slice(held["parts"], 1, F.size(held["parts"]) - 1), F.array(F.concat(F.element_at(held["parts"], -1), part)))
        return F.struct(depth.alias("depth"), F.when(splits, F.concat(held["parts"], F.array(F.lit("")))).otherwise(longer).alias("parts"))

    parts = F.aggregate(F.regexp_extract_all(text, F.lit(PARTS), F.lit(0)), start, step)["parts"]
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def prerequisite_segments(text: Column) -> Column:
    """Alternatives of a requirement text, each as the sorted array of its course codes: all of one are needed.

    Brackets of consent, placement and the like go first; only an ``or`` or ``/`` outside brackets parts alternatives; segments without a code are left out. A code is capitals or small letters, at
    least two, and a number that a letter may follow.
    """
    bare = F.transform(alternatives(without_asides(text)), lambda p: F.regexp_replace(p, r"(?i)\band\b|,|;", " "))
    found = F.transform(bare, lambda p: F.regexp_extract_all(F.upper(p), F.lit(r"([A-Z]{2,}\s*\d+[A-Z]?)"), F.lit(1)))
    codes = F.transform(found, lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.regexp_replace(x, r"^([A-Z]+)\s*(\d+)([A-Z]?)$", "$1 $2$3")))))
    return F.filter(codes, lambda c: F.size(c) > 0)


def requirement_edges(text: Column, kind: Column) -> Column:
    """array<struct<kind, courses>>: an edge of the kind (prerequisite, corequisite, ...) for each alternative of the text."""
    return F.transform(F.coalesce(prerequisite_segments(text), F.array().cast("array<array<string>>")), lambda c: F.struct(kind.alias("kind"), c.alias("courses")))
