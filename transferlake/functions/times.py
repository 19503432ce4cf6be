"""Column functions for meeting days, clock times, terms and event dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day marks, longest first, and their numbers; N has no fixed day.
DAYS = {"Th": 4, "Sa": 6, "Su": 7, "M": 1, "T": 2, "W": 3, "F": 5, "S": 6, "U": 7}
#: First month of a season.
SEASON_MONTH = {"Winter": 12, "Spring": 1, "Summer": 6, "Fall": 8}


def meeting_days(text: Column) -> Column:
    """Sorted day numbers, Monday 1, of a day string such as ``MTTh``; empty for ``N`` or nothing."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(Th|Sa|Su|M|T|W|F|S|U)"), F.lit(1))
    numbers = F.create_map(*(x for k, v in DAYS.items() for x in (F.lit(k), F.lit(v))))
    return F.array_sort(F.array_distinct(F.transform(marks, lambda m: numbers[m])))


def clock_minutes(text: Column) -> Column:
    """Minutes of the day of ``h:mm a.m.``; null without a morning or afternoon mark."""
    parts = r"(?i)^\s*(\d{1,2}):(\d{2})\s*([ap])\.?m\.?\s*$"
    hour = F.nullif(F.regexp_extract(text, parts, 1), F.lit("")).cast("int") % 12
    afternoon = F.lower(F.regexp_extract(text, parts, 3)) == "p"
    return hour * 60 + F.nullif(F.regexp_extract(text, parts, 2), F.lit("")).cast("int") + F.when(afternoon, 720).otherwise(0)


def time_range(text: Column) -> Column:
    """Struct (begins, ends) of ``h:mm a.m.-h:mm p.m.`` with any dash; nulls where a side is unclear."""
    sides = F.split(F.translate(F.coalesce(text, F.lit("")), "–—", "--"), "-")
    return F.struct(clock_minutes(F.get(sides, F.lit(0))).alias("begins"), clock_minutes(F.get(sides, F.lit(1))).alias("ends"))


def time_bucket(begins: Column) -> Column:
    return F.when(begins < 720, "morning").when(begins < 1020, "afternoon").when(begins.isNotNull(), "evening")


def term_order(term: Column) -> Column:
    """Year * 100 + first month of ``F2024``, ``S2024``, ``Su2024``, ``W2024`` or ``Fall 2024``; null otherwise."""
    whole = r"^\s*(Winter|Spring|Summer|Fall|Su|W|S|F)\s*(\d{4})\s*$"
    letters = {"W": "Winter", "S": "Spring", "Su": "Summer", "F": "Fall"}
    months = {**SEASON_MONTH, **{short: SEASON_MONTH[season] for short, season in letters.items()}}
    month = F.create_map(*(x for k, v in months.items() for x in (F.lit(k), F.lit(v))))
    return F.nullif(F.regexp_extract(term, whole, 2), F.lit("")).cast("int") * 100 + month[F.nullif(F.regexp_extract(term, whole, 1), F.lit(""))]


def is_future_term(term: Column, year: int, month: int) -> Column:
    return term_order(term) > year * 100 + month
