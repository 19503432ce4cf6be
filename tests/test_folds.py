"""Notes merged and requirement texts split, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from transferlake.functions import parsing
from transferlake.operators import quality
from transferlake.sources import hard_lines


def goes_on(note, line):
    if note.endswith(tuple(quality.OPEN_ENDS)) or any(p in note for p in quality.OPEN_PARTS) or line.startswith(tuple(quality.GOES_ON)):
        return True
    if not note.endswith((".", "!", "?", ":")) and line[:1].islower():
        return True
    last, first = (note.split() or [""])[-1], (line.split() or [""])[0].rstrip(".,;:")
    if last[:1].isupper() and first[:1].isupper() and first not in quality.STARTERS:
        return True
    return note.endswith(",") and any(a in note.lower() for a in quality.ADDRESSES)


def joined(note, line):
    web = (note.endswith("/") and not line.startswith(" ")) or (note.endswith("to smc.") and line.startswith("edu/OnlineEd."))
    return note + ("" if web else " ") + line


def to_a_fixpoint(lines):
    """Neighbours are merged pair by pair, again and again until nothing changes."""
    notes, changed = list(lines), True
    while changed:
        changed, out, i = False, [], 0
        while i < len(notes):
            if i + 1 < len(notes) and goes_on(notes[i], notes[i + 1]):
                out.append(joined(notes[i], notes[i + 1]))
                i, changed = i + 2, True
            else:
                out.append(notes[i])
                i += 1
        notes = out
    return notes


def test_notes_are_those_of_repeated_merging(spark):
    rng = random.Random(4)
    docs = {d: [f.replace("#", str(rng.randrange(9))) for f in rng.choices([*hard_lines.FRAGMENTS, " starts with a space", "ends the band"], k=rng.randrange(1, 12))] for d in range(300)}
    lines = spark.createDataFrame([(d, i, x) for d, l in docs.items() for i, x in enumerate(l)] + [(900, 0, None)], "doc_id long, line_no int, line string")
    got = {}
    for r in quality.merge_notes(lines).orderBy("doc_id", "first_line").collect():
        got.setdefault(r.doc_id, []).append((r.first_line, r.n, r.text))
    assert {d: [t for _, _, t in notes] for d, notes in got.items()} == {d: to_a_fixpoint(l) for d, l in docs.items()}
    assert all(notes[0][0] == 0 and [a + n for a, n, _ in notes] == [*(a for a, _, _ in notes[1:]), len(docs[d])] for d, notes in got.items())
    assert quality.merge_notes(lines.limit(0)).count() == 0


def edges(text):
    stack = [""]
    for c in text:
        if c == "(":
            stack.append("")
        elif c == ")" and len(stack) > 1:
            inner = stack.pop()
            if not any(a in inner.lower() for a in parsing.ASIDES):
                stack[-1] += f"({inner})"
        else:
            stack[-1] += c
    text, depth, parts, i = "(".join(stack), 0, [""], 0
    while i < len(text):
        c = text[i]
        depth = depth + 1 if c == "(" else max(depth - 1, 0) if c == ")" else depth
        word = text[i : i + 2].lower() == "or" and not text[i - 1 : i].isalpha() and not text[i + 2 : i + 3].isalpha()
        if depth == 0 and c != ")" and (c == "/" or word):
            parts.append("")
            i += 2 if word else 1
            continue
        parts[-1] += c
        i += 1
    out = []
    for p in parts:
        found = re.findall(r"([A-Z]{2,}\s*\d+[A-Z]?)", re.sub(r"\band\b|,|;", " ", p, flags=re.I).upper())
        codes = {re.sub(r"^([A-Z]+)\s*(\d+)([A-Z]?)$", r"\1 \2\3", c) for c in found}
        if codes:
            out.append(sorted(codes))
    return out


def test_edges_of_nested_texts(spark):
    rng = random.Random(6)
    pieces = ["MATH 1", "bio 2a", " or ", "/", " and ", ", ", "(", ")", "(same as ", "placement", " corner 5 ", "for ", "CHEM  3", " OR ", "within 2 years"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 14))) for _ in range(500)] + ["(MATH 1 or (BIO 2 (placement)))", "((((", "))) MATH 1", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.requirement_edges(F.col("t"), F.lit("advisory")).alias("e"))
    for r in df.collect():
        assert [list(x.courses) for x in r.e] == (edges(r.t) if r.t else []), r.t
        assert all(x.kind == "advisory" for x in r.e)


def test_page_furniture_goes_and_text_stays(spark):
    from transferlake.operators import catalogue

    word = dict(enumerate("zero anatomy botany chemistry dance".split()))
    pages = [["Running title p. %d" % n, f"Course {word[n]} needs measure-", "ment of things.", "B", "U", "R I S K   A N D  R E T U R N", "It goes on", "in lower case", f"Unique line {n}:", f"a note on {word[n]}", "12", "Go to list Fall 2025", str(12 + n)] for n in range(1, 5)]
    rows = [(1, i, x) for i, x in enumerate(x for p in pages for x in p)] + [(2, 0, "Running title p. 1"), (2, 1, "140"), (2, 2, "require-"), (2, 3, "ment"), (2, 4, None), (2, 5, "  lots   of   space ")]
    got = catalogue.cleaned(spark.createDataFrame(rows, "doc_id long, line_no int, line string")).orderBy("doc_id", "first_line").collect()
    kept = [t for n in range(1, 5) for t in (f"Course {word[n]} needs measurement of things.", "It goes on in lower case", f"Unique line {n}:", f"a note on {word[n]}")]
    assert [r.text for r in got if r.doc_id == 1 and r.text != "12"] == kept
    assert [r.text for r in got if r.doc_id == 2] == ["Running title p. 1", "140 requirement lots of space"]
