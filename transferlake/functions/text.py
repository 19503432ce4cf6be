"""Column functions for plain text and html."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as keywords, and words that always do.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "you", "your", "can", "do", "if"]
IMPORTANT = ["transfer", "degree", "units", "gpa", "counselor", "smc", "transcript", "appointment", "associate", "certificate", "igetc", "csu", "uc", "financial", "visa", "f-1", "i-20", "international", "canvas", "online", "zoom", "synchronous", "asynchronous", "proctoring", "technical", "enrollment", "immigration", "sevis", "opt", "cpt", "work"]
# Categories of questions by audience, in order, with the words of which one must occur; the last has none.
CATEGORIES = {
    "international": [
        ("Visa and Immigration", ["visa", "f-1", "i-20", "sevis", "immigration", "passport"]),
        ("Transfer for International Students", ["transfer", "university"]),
        ("Enrollment Requirements", ["unit", "full-time", "enrollment", "drop", "withdraw"]),
        ("Work Authorization", ["work", "employment", "cpt", "opt"]),
        ("Health and Insurance", ["health", "insurance"]),
        ("International Student Services", []),
    ],
    "student": [
        ("Canvas and Account Access", ["canvas", "login", "access", "password", "account", "username"]),
        ("Technical Requirements", ["technical", "computer", "browser", "internet", "software", "requirements"]),
        ("Online Testing and Exams", ["exam", "test", "proctoring", "quiz", "assessment"]),
        ("Class Format and Schedule", ["zoom", "meeting", "synchronous", "asynchronous", "schedule", "online class"]),
        ("Student Support Services", ["help", "support", "tutoring", "assistance", "contact"]),
        ("Enrollment and Registration", ["enroll", "add", "drop", "registration", "corsair connect"]),
        ("Online Learning General", []),
    ],
}


def html_text(html: Column, gap: str = " ") -> Column:
    """Text of a page: scripts, styles, comments and tags replaced by ``gap``, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>|<!--.*?-->", gap)
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", gap)
    bare = F.regexp_replace(F.regexp_replace(bare, "&nbsp;", " "), "&amp;", "&")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def heading(html: Column) -> Column:
    """The text of the first heading; null without one."""
    inner = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")
    return F.nullif(F.trim(F.regexp_replace(inner, r"\s+", " ")), F.lit(""))


def _visible(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->", " ")


def paragraphs(html: Column, most: int) -> Column:
    """Texts of the first paragraphs that are not empty."""
    found = F.regexp_extract_all(_visible(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    bare = F.transform(found, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), r"\s+", " ")))
    return F.slice(F.filter(bare, lambda p: p != ""), 1, most)


def degrees(html: Column) -> Column:
    """Degree marks in the visible text, each once, sorted."""
    said = F.regexp_replace(_visible(html), "<[^>]*>", " ")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(said, F.lit(r"\b([BM]\.?[SA]\.?)(?:\s|$)"), F.lit(1))))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


def absolute(link: Column, base: Column) -> Column:
    """A link under the address of its page's site; mail and telephone links and full addresses stay."""
    return F.when(link.rlike("^(https?://|mailto:|tel:)"), link).when(F.startswith(link, F.lit("/")), F.concat(base, link)).otherwise(F.concat(base, F.lit("/"), link))


def sentences(text: Column) -> Column:
    """Parts behind full stops, question and exclamation marks; empty ones dropped."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def pack_sentences(text: Column, most: int, overlap: int = 0) -> Column:
    """Consecutive sentences joined by spaces while they fit into ``most`` characters; a longer one stands alone.

    With ``overlap`` 1 a chunk begins with the last sentence of the one before.
    """

    def add(held: Column, s: Column) -> Column:
        fits = F.length(held["open"]) + 1 + F.length(s) <= most
        joined = F.concat(held["open"], F.lit(" "), s)
        begun = F.concat(held["last"], F.lit(" "), s) if overlap else s
        kept = F.when(held["open"].isNull() | fits, held["done"]).otherwise(F.concat(held["done"], F.array(held["open"])))
        return F.struct(kept.alias("done"), F.when(held["open"].isNull(), s).when(fits, joined).otherwise(begun).alias("open"), s.alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(None).cast("string").alias("last"))
    return F.aggregate(sentences(text), start, add, lambda held: F.when(held["open"].isNull(), held["done"]).otherwise(F.concat(held["done"], F.array(held["open"]))))


# Sentences that stand alone in a chunk.
PRESERVE_PATTERNS = [r"(?i)MATH \d+[A-Z]?: .+? \(\d+\.\d+ units?\)", r"(?i)https?://[^\s]+", r"(?i)For more information.+?\.edu"]


def pack_preserve(text: Column, most: int = 800, least: int = 150, patterns: list[str] | None = None) -> Column:
    """Chunks of sentences of at most ``most`` characters, each with a space behind it; sentences of a pattern stand alone, and a chunk shorter than ``least`` takes in the next."""
    alone = lambda s: reduce(Column.__or__, (s.rlike(p) for p in (patterns or PRESERVE_PATTERNS)))
    closed = lambda held: F.when(held["open"].isNull(), held["done"]).otherwise(F.concat(held["done"], F.array(held["open"])))

    def add(held: Column, s: Column) -> Column:
        fits = held["open"].isNotNull() & (F.length(held["open"]) + F.length(s) + 2 <= most)
        done = F.when(alone(s), F.concat(closed(held), F.array(s))).when(fits, held["done"]).otherwise(closed(held))
        return F.struct(done.alias("done"), F.when(alone(s), F.lit(None).cast("string")).when(fits, F.concat(held["open"], F.lit(" "), s)).otherwise(s).alias("open"))

    def merge(held: Column, chunk: Column) -> Column:
        short = held["open"].isNotNull() & (F.length(held["open"]) < least)
        return F.struct(F.when(short, held["done"]).otherwise(closed(held)).alias("done"), F.when(short, F.concat(held["open"], F.lit(" "), chunk)).otherwise(chunk).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    return F.aggregate(F.aggregate(sentences(text), start, add, closed), start, merge, closed)


def pack_lines(header: Column, lines: Column, most: int = 1_000) -> Column:
    """Chunks of lines of at most ``most`` characters, each under the header; a longer line stands alone under it."""

    def add(held: Column, line: Column) -> Column:
        fits = F.length(held["open"]) + 1 + F.length(line) <= most
        return F.struct(F.when(fits, held["done"]).otherwise(F.concat(held["done"], F.array(held["open"]))).alias("done"), F.concat(F.when(fits, held["open"]).otherwise(header), F.lit("\n"), line).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), header.alias("open"))
    return F.aggregate(lines, start, add, lambda held: F.concat(held["done"], F.array(held["open"])))


def keywords(text: Column, most: int = 15) -> Column:
    """Distinct words (letters a-z, digits and hyphens) in order that are important, or longer than three characters and no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z0-9-]+)\b"), F.lit(1))
    kept = F.filter(words, lambda w: w.isin(IMPORTANT) | ((F.length(w) > 3) & ~w.isin(STOP_WORDS)))
    return F.slice(F.array_distinct(kept), 1, most)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs, as a part of another or not."""
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def rule_category(question: Column, audience: Column) -> Column:
    """The first category of the audience one of whose words occurs in the question; ``General`` for other audiences."""
    low, chosen = F.lower(question), F.lit("General")
    for who, rules in CATEGORIES.items():
        own = F.lit(rules[-1][0])
        for category, words in reversed(rules[:-1]):
            own = F.when(has_any(low, words), category).otherwise(own)
        chosen = F.when(audience == who, own).otherwise(chosen)
    return chosen
