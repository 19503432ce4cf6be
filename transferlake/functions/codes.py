"""Column functions for course codes, units, grades and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def course_code(text: Column, rule: str = "strict") -> Column:
    """A course code in its canonical form, null where the text is none.

    strict: the whole text is a prefix, a number and perhaps a letter, joined by one space. compact: letters
    and digits only, a prefix of 2 to 8 letters, a number and up to two letters. search: the first prefix of 2
    to 4 letters with a number, anywhere. spaced: white space collapsed, nothing else.
    """
    up = F.upper(F.trim(text))
    if rule == "strict":
        parts = r"^([A-Z]{1,12})\s*(\d{1,4})([A-Z]?)$"
        return F.when(up.rlike(parts), F.concat(F.regexp_extract(up, parts, 1), F.lit(" "), F.regexp_extract(up, parts, 2), F.regexp_extract(up, parts, 3)))
    if rule == "compact":
        bare = F.regexp_replace(up, "[^A-Z0-9]", "")
        parts = r"^([A-Z]{2,8})(\d+)([A-Z]{0,2})$"
        return F.when(bare.rlike(parts), F.concat(F.regexp_extract(bare, parts, 1), F.lit(" "), F.regexp_extract(bare, parts, 2), F.regexp_extract(bare, parts, 3)))
    if rule == "search":
        return F.nullif(F.regexp_extract(up, r"([A-Z]{2,4}\s*\d+[A-Z]?)", 1), F.lit(""))
    if rule == "spaced":
        return F.trim(F.regexp_replace(up, r"\s+", " "))
    raise ValueError(rule)


def all_codes(text: Column) -> Column:
    """Every code of a text whose white space is taken out first: a prefix of 2 to 4 letters, a number, perhaps a letter."""
    return F.regexp_extract_all(F.upper(F.regexp_replace(text, r"\s+", "")), F.lit(r"([A-Z]{2,4}\d+[A-Z]?)"), F.lit(1))


def slug(text: Column) -> Column:
    """Lower case, degree marks and bracketed parts removed, other runs one hyphen."""
    bare = F.regexp_replace(F.lower(text), r"\([^)]*\)|\b[bm]\.?[as]\.?\b", " ")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_number(text: Column) -> Column:
    """The first number of a text as a double, null without one."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def is_honors(code: Column, title: Column) -> Column:
    """The code ends in a number and H, or the title says honors or ends with H."""
    return F.coalesce(code.rlike(r"\d+H$"), F.lit(False)) | F.coalesce(F.upper(title).rlike(r"HONORS|\bH$"), F.lit(False))


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def name_key(full_name: Column) -> Column:
    """Last word and first initial of a name, lower-cased."""
    words = F.split(F.trim(F.lower(full_name)), r"\s+")
    return F.concat(F.element_at(words, -1), F.lit("|"), F.substring(F.element_at(words, 1), 1, 1))


def file_slug(name: Column) -> Column:
    """A name as a file's: lower case, & as and, no hyphens, full stops or colons, underscores for spaces."""
    low = F.replace(F.lower(name), F.lit("&"), F.lit("and"))
    return F.replace(F.replace(F.trim(F.regexp_replace(low, "[.:-]", "")), F.lit("  "), F.lit(" ")), F.lit(" "), F.lit("_"))


def bare_slug(name: Column) -> Column:
    """A name without brackets and degree marks, with underscores for all else that is no letter or digit."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"\(.*?\)", ""), r"\b[bm]\.?[as]\.?\b", "")
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def unit_range(said: Column) -> Column:
    """Struct (least, most) of ``3 - 5 units`` or ``4``; nulls without a number."""
    number = r"(\d+(?:\.\d+)?)"
    least = F.nullif(F.regexp_extract(said, number, 1), F.lit("")).cast("double")
    most = F.nullif(F.regexp_extract(said, rf"{number}\s*(?:-|to)\s*{number}", 2), F.lit("")).cast("double")
    return F.struct(least.alias("least"), F.coalesce(most, least).alias("most"))


def agreement_url(year: Column, institution: Column, agreement: Column, major: Column, site: str = "https://agreements.example.org/results") -> Column:
    """The address of an agreement; its key is written as one parameter."""
    key = F.concat_ws("/", year, institution, F.lit("to"), agreement, F.lit("Major"), major)
    return F.concat(F.lit(f"{site}?year="), year, F.lit("&institution="), institution, F.lit("&agreement="), agreement, F.lit("&viewByKey="), F.url_encode(key))


def url_part(url: Column, name: str) -> Column:
    return F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def url_major(url: Column) -> Column:
    """The last part of an agreement's key, if that has six parts or more."""
    parts = F.split(url_part(url, "viewByKey"), "/")
    return F.when(F.size(parts) >= 6, F.element_at(parts, -1))
