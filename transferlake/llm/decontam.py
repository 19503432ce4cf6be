"""Benchmark decontamination by canonical templates.

Numbers, names and units of documents and benchmark items become typed placeholders, so that a question asked again with
other values gives the same template. Windows of the template are hash-joined, and the values behind the
placeholders must agree: a value of the item stands for one value of the document throughout. Beside the templates, copies are found
by windows of the lower-cased words as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_slices

WINDOW = 5
#: Words of a window that must stand as they are, so that placeholders alone never match.
LITERALS = 3
#: An item is leaked by this share of its windows, or by this many.
SHARE, ENOUGH = 0.8, 8
#: Bits of the filter that documents' windows pass before the join, as powers of two: 1,024 a window of the benchmark, within these bounds (32 MB at most).
FILTER_BITS = (22, 28)
REMEMBERED = 200_000
#: Widths of the runs of diagonals (place in the document less place in the item) that are judged as one occurrence of an item.
SPANS = (1, 4, 16, 64)

_SPACELESS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: In scripts without spaces each character is a word.
TOKEN = regex.compile(rf"(?V1)\d+(?:[.,:/]\d+)*|[{_SPACELESS}]\p{{M}}*|[[^\W\d_]--[{_SPACELESS}]]+|[.!?\n]")
#: The same for texts with nothing BEYOND Latin letters and common punctuation, where it is faster.
LATIN_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_²³¹¼½¾]+|[.!?\n]")
BEYOND = re.compile(r"[\u0300-\u200f\u2028-\u20ab\u20ad-\U0010ffff]")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
#: Units count as such behind a number only.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers gram grams kilogram kilograms degree degrees percent dollar dollars cent cents euro euros mph kmh".split())
WORD, NAME, NUMBER, UNIT, MARK, CAPITALS = range(6)
#: How an item's window may match: by template, as a copy.
TEMPLATE, COPY = 1, 2
_PLACEHOLDERS = np.array([xxhash.xxh64_intdigest(b"\x00placeholder %d" % k) for k in range(4)], np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW + 1)], np.uint64)
#: Places of a window that may be names at once, as bits, with enough words left.
_NAMES = [m for m in range(1 << WINDOW) if m.bit_count() <= WINDOW - LITERALS]


class Tokens(dict):
    """Hash of a token's lower-cased form, its low three bits replaced by a kind."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        low = token.lower()
        if token in ".!?\n":
            kind = MARK
        elif token[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif token[0].isupper():
            kind = CAPITALS if len(token) > 1 and token.isupper() else NAME
        else:
            kind = WORD
        code = self[token] = xxhash.xxh64_intdigest(low.encode()) & ~7 | kind
        return code


def split(text: str) -> list[str]:
    return (TOKEN if BEYOND.search(text) else LATIN_TOKEN).findall(text)


def template(tokens: Tokens, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, the hashes of their lower-cased forms, their kinds, the kinds that they have by their letters, and their texts.

    A word with a capital is a name unless it opens a sentence or is all capitals; a unit counts behind a number.
    """
    parts = [split(t) for t in texts]
    words, sizes = list(chain.from_iterable(parts)), list(map(len, parts))
    code = np.fromiter(map(tokens.__getitem__, words), np.uint64, len(words))
    letters = (code & np.uint64(7)).astype(np.int8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    before = np.append(np.int8(MARK), letters[:-1])[: len(letters)]
    before[1:][owner[1:] != owner[:-1]] = MARK
    kind = letters.copy()
    kind[((kind == NAME) & (before == MARK)) | ((kind == UNIT) & (before != NUMBER)) | (kind == CAPITALS)] = WORD
    word = np.flatnonzero(letters != MARK)
    if len(word) < len(words):
        words = [words[i] for i in word.tolist()]
    return words, code[word] & ~np.uint64(7), kind[word], letters[word], owner[word]


def _mixed(hashed: np.ndarray) -> np.ndarray:
    hashed = hashed ^ hashed >> np.uint64(31)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    return hashed ^ hashed >> np.uint64(27)


def runs_of(code: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all runs of ``size`` words of one text, as they are; fewer words than a window are hashed apart by their number."""
    n = max(0, len(code) - size + 1)
    at = np.flatnonzero(owner[:n] == owner[size - 1 : size - 1 + n])
    hashed = reduce(np.add, (code[k : k + n] * _POWERS[k] for k in range(size)))
    return at, _mixed(hashed[at] + np.uint64(WINDOW - size) * _POWERS[WINDOW])


def templates(code: np.ndarray, kind: np.ndarray, letters: np.ndarray, owner: np.ndarray, named: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and name places of windows with a placeholder and enough literal words.

    Numbers and units are placeholders; a word whose letters are one of ``named`` is tried as a name and as a word.
    """
    n = max(0, len(code) - WINDOW + 1)
    fixed, may = (kind == NUMBER) | (kind == UNIT), np.isin(letters, named) & (kind != UNIT)
    counts = np.cumsum(np.append(0, fixed))
    counts = counts[WINDOW:] - counts[:-WINDOW] if n else np.zeros(0, np.int64)
    bits = reduce(np.bitwise_or, (may[k : k + n].astype(np.uint8) << k for k in range(WINDOW)))
    some = np.flatnonzero((owner[:n] == owner[WINDOW - 1 : WINDOW - 1 + n]) & ((bits > 0) | (counts > 0)) & (counts <= WINDOW - LITERALS))
    bits, counts = bits[some], counts[some]
    code = np.where(fixed, _PLACEHOLDERS[np.minimum(kind, UNIT)], code)
    base = reduce(np.add, (code[some + k] * _POWERS[k] for k in range(WINDOW)))
    at, hashed, names = [], [], []
    for m in _NAMES:
        own = np.flatnonzero(((bits & m) == m) & (counts + m.bit_count() <= WINDOW - LITERALS) & ((counts > 0) | (m > 0)))
        if len(own):
            at.append(some[own])
            hashed.append(_mixed(reduce(np.add, ((_PLACEHOLDERS[NAME] - code[some[own] + k]) * _POWERS[k] for k in range(WINDOW) if m >> k & 1), base[own])))
            names.append(np.full(len(own), m))
    return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.uint64), *hashed]), np.concatenate([np.zeros(0, np.int64), *names])


def item_rows(tokens: Tokens, text: str) -> list[tuple[int, int, int, int, list[dict[str, object]]]]:
    """(at, hash, size, paths, slots) of an item: its windows as copies, in every reading of their names as templates, and a short item as a whole."""
    words, code, kind, letters, owner = template(tokens, [text])
    if not words:
        return []
    low = [w.lower() for w in words]
    size = min(WINDOW, len(words))
    at, hashed = runs_of(code, owner, size)
    other = kind != WORD
    enough = [size == WINDOW and int(other[a : a + WINDOW].sum()) <= WINDOW - LITERALS for a in range(len(at))]
    given = (kind == NUMBER) | (kind == UNIT)
    slots = lambda a, names: [{"k": k, "asked": low[a + k], "name": not given[a + k]} for k in range(WINDOW) if other[a + k] or names >> k & 1]
    rows = []
    for a, h in zip(at.tolist(), hashed.view(np.int64).tolist(), strict=True):
        both = enough[a] and not given[a : a + WINDOW].any()
        rows.append((a, h, size, COPY | TEMPLATE if both else COPY, slots(a, 0) if both else []))
    at, hashed, names = templates(code, kind, letters, owner, (NAME, CAPITALS))
    for a, h, m in zip(at.tolist(), hashed.view(np.int64).tolist(), names.tolist(), strict=True):
        if enough[a]:
            rows.append((a, h, WINDOW, TEMPLATE, slots(a, m)))
    return rows


def _items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    kind_of_id = benchmark.schema[id_column].dataType.simpleString()
    columns = {"at": pa.int64(), "hash": pa.int64(), "size": pa.int32(), "paths": pa.int32(), "slots": pa.list_(pa.struct({"k": pa.int32(), "asked": pa.string(), "name": pa.bool_()}))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = Tokens(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("id")
            for start, texts in text_slices(batch, "text"):
                for k, text in enumerate(texts):
                    found = item_rows(tokens, text)
                    if found:
                        values = [pa.array(v, t) for v, t in zip(zip(*found, strict=True), columns.values(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row + k)), ids.take(pa.array(np.full(len(found), start + k))), *values], names=["row", "id", *columns])
                row += len(texts)

    return benchmark.select(benchmark[id_column].alias("id"), benchmark[text_column].alias("text")).mapInArrow(run, f"row long, id {kind_of_id}, at long, hash long, size int, paths int, slots array<struct<k: int, asked: string, name: boolean>>")


def _filter(items: DataFrame) -> tuple[int, np.ndarray]:
    """(b, bits): bits is a filter of 2 ** b bits in which those at the first b bits of the items' hashes are set."""
    low, high = FILTER_BITS
    size = min(high, max(low, (1024 * items.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - size)
    parts = items.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits")).collect()  # 4 KB each, 8,192 at most
    bits = np.zeros((1 << size) // 8, np.uint8)
    for part, held in parts:
        bits[4096 * part : 4096 * (part + 1)] = np.frombuffer(held, np.uint8)
    return size, bits


def _found(docs: DataFrame, id_column: str, text_column: str, size_of_filter: int, passes: np.ndarray, short: list[int]) -> DataFrame:
    """(row, id, at, hash, words) of the documents' windows, and of runs of ``short`` sizes, whose filter bit is set; a repeated short run once a text."""
    kind_of_id = docs.schema[id_column].dataType.simpleString()
    shared, shift = docs.sparkSession.sparkContext.broadcast(passes), np.uint64(64 - size_of_filter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, row = Tokens(), TaskContext.get().partitionId() << 40
        bits = shared.value
        for batch in batches:
            ids = batch.column("id")
            for start, texts in text_slices(batch, "text"):
                words, code, kind, letters, owner = template(tokens, texts)
                first = np.searchsorted(owner, np.arange(len(texts)))
                places, hashes = [], []
                for size, (at, hashed) in [(WINDOW, runs_of(code, owner, WINDOW)), (WINDOW, templates(code, kind, letters, owner, (NAME,))[:2]), *((n, runs_of(code, owner, n)) for n in short)]:
                    place = (hashed >> shift).astype(np.int64)
                    hit = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    at, hashed = at[hit], hashed[hit]
                    if size < WINDOW and len(at):
                        order = np.lexsort((at, hashed, owner[at]))
                        order = order[np.append(True, (np.diff(owner[at][order]) != 0) | (hashed[order][1:] != hashed[order][:-1]))]
                        at, hashed = at[order], hashed[order]
                    places.append(at)
                    hashes.append(hashed)
                at = np.concatenate(places)
                if len(at):
                    own = owner[at]
                    held = [[w.lower() for w in words[a : a + WINDOW]] for a in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own + row), ids.slice(start, len(texts)).take(pa.array(own)), pa.array(at - first[own]), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(held, pa.list_(pa.string()))], names=["row", "id", "at", "hash", "words"])
                row += len(texts)

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, f"row long, id {kind_of_id}, at long, hash long, words array<string>")


def _consistent(hits: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_consistent): the item's windows that have a place whose values agree, judged within each of keys."""
    slots = hits.select(*keys, "at", "item_at", "hash", "words", F.explode("item_slots").alias("s")).select(*keys, "at", "item_at", "hash", "s.k", "s.asked", "s.name", F.element_at("words", F.col("s.k") + 1).alias("given"))
    places = slots.drop("hash").distinct()  # a place may match in several readings
    bound = places.groupBy(*keys, "asked", "name", "given").agg(F.count("*").alias("n")).groupBy(*keys, "asked", "name").agg(F.max(F.struct("n", "given")).alias("most")).select(*keys, "asked", "name", "most.*")
    # Two names of the item are not one name of the document: the one that is met more often has it.
    holders = bound.where("name").groupBy(*keys, "given").agg(F.min(F.struct((-F.col("n")).alias("n"), "asked")).alias("first")).select(*keys, "given", F.col("first.asked").alias("asked"), F.lit(True).alias("name"))
    bound = bound.where("not name").select(*keys, "asked", "name", "given").unionByName(holders)
    broken = slots.join(bound.withColumn("bound", F.lit(True)), [*keys, "asked", "name", "given"], "left").where("bound is null").select(*keys, "at", "item_at", "hash").distinct()
    # A window of the item counts once, at its consistent places if it has any.
    marked = hits.select(*keys, "at", "item_at", "hash").join(broken.withColumn("bad", F.lit(1)), [*keys, "at", "item_at", "hash"], "left")
    each = marked.groupBy(*keys, "item_at").agg(F.max(F.col("bad").isNull().cast("int")).alias("good"))
    return each.groupBy(*keys).agg(F.sum("good").alias("n_consistent"))


def _needed(n_windows: Column) -> Column:
    """The windows that make a leak of an item with so many."""
    return F.least(F.lit(ENOUGH), F.ceil(n_windows * SHARE))


def _rare(own: DataFrame, found: DataFrame) -> DataFrame:
    """(item_row, hash): of each item the windows that documents hold least often, just so many that a leak must hold one of them.

    A window such as "what is the value of" stands in many items and documents and would bring every two of them together; left
    out here, it still counts for the pairs that rarer windows bring together.
    """
    often = found.groupBy("hash").agg(F.count("*").alias("often"))
    windows = own.join(often, "hash", "left").groupBy("item_row", "item_at").agg(F.sum(F.coalesce("often", F.lit(0))).alias("often"))
    ranked = windows.withColumn("place", F.row_number().over(Window.partitionBy("item_row").orderBy("often", "item_at"))).withColumn("n", F.count("*").over(Window.partitionBy("item_row")))
    chosen = ranked.where((F.col("often") > 0) & (F.col("place") <= F.col("n") - _needed(F.col("n")) + 1)).select("item_row", "item_at")
    return own.join(chosen, ["item_row", "item_at"]).select("item_row", "hash").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(id, item_id, n_windows, n_matched, n_consistent, share): the items that documents leak.

    n_windows are the item's template windows of five words, n_matched those that the document holds, and n_consistent
    those of them whose values agree: within an occurrence of the item, each value of the item stands for the document's value that
    it meets most often, no two names of the item for one name of the document (numbers may coincide), and the occurrence with the most windows counts.
    Occurrences are the windows on one diagonal, those on
    neighbouring ones (runs of SPANS diagonals, overlapping by half, for copies with words put in or left out), and the whole document. An item is
    leaked if min(ENOUGH, SHARE of its windows, rounded up) are consistent.

    Items are also searched as copies, by all windows of five of their words as they are, whatever the case, with the same shares; an item of
    fewer words is one window, found wherever its words stand in a row, even a single one. An item that is leaked both ways gives the
    row of its template. Names are read as words too, and the first word of a sentence as a name, so that labels, lower case and capitals do
    not hide a copy. An item without words matches nothing. Null texts are empty; texts of any length are read whole, in time in proportion; items of
    the same template count each, so ties give a row each; repeated documents give a row each time; rows with a null id keep it; other columns play no part; an empty
    table on either side gives no rows.

    Documents are read once. A filter whose size follows the benchmark's lets through the windows that can match; only those are
    shuffled. Documents and items meet on the windows of an item that are rarest in the documents (see ``_rare``), and only pairs that do are
    joined on all windows. Joins are left to
    adaptive execution: the benchmark is broadcast if it is measured to be small, and large partitions are split if not.
    """
    items = checkpointed(_items(benchmark, item_column, item_text_column))
    short = sorted(r.size for r in items.where(F.col("size") < WINDOW).select("size").distinct().collect())  # four at most
    found = checkpointed(_found(docs, id_column, text_column, *_filter(items), short))
    own = items.select(F.col("row").alias("item_row"), F.col("id").alias("item"), F.col("at").alias("item_at"), "hash", "paths", F.col("slots").alias("item_slots"))
    by_path = [own.where(F.col("paths").bitwiseAND(F.lit(p)) > 0) for p in (TEMPLATE, COPY)]
    rare = _rare(by_path[0], found).union(_rare(by_path[1], found)).distinct()
    met = found.select("row", "hash").join(rare, "hash").select("row", "item_row").distinct()
    every = checkpointed(met.join(own, "item_row").join(found, ["row", "hash"]))
    hits, copies = (every.where(F.col("paths").bitwiseAND(F.lit(p)) > 0) for p in (TEMPLATE, COPY))
    sizes, copy_sizes = (df.groupBy("item_row").agg(F.count_distinct("item_at").alias("n_windows")) for df in by_path)
    enough = _needed(F.col("n_windows"))
    pair = ("row", "item_row", "id", "item")
    matched = hits.select(*pair, "item_at").distinct().groupBy(*pair).agg(F.count("*").alias("n_matched"))
    whole = checkpointed(matched.join(sizes, "item_row").where(F.col("n_matched") >= enough).join(_consistent(hits, *pair[:2]), [*pair[:2]]))
    # Only where a window fails can an occurrence hold more than the document as a whole.
    open_ = hits.join(whole.where("n_consistent < n_matched").select(*pair[:2]), [*pair[:2]], "left_semi")
    diagonal = F.col("at") - F.col("item_at")
    runs = [F.struct(F.lit(k).alias("kind"), F.floor((diagonal + shift) / span).alias("run")) for k, (span, shift) in enumerate((span, shift) for span in SPANS for shift in sorted({0, span // 2}))]
    each = _consistent(open_.withColumn("occurrence", F.explode(F.array(*runs))), *pair[:2], "occurrence")
    best = each.groupBy(*pair[:2]).agg(F.max("n_consistent").alias("n_best"))
    counted = whole.join(best, [*pair[:2]], "left").withColumn("n_consistent", F.greatest("n_consistent", "n_best"))
    copied = copies.select(*pair, "item_at").distinct().groupBy(*pair).agg(F.count("*").alias("n_matched")).join(copy_sizes, "item_row").withColumn("n_consistent", F.col("n_matched"))
    ways = [df.where(F.col("n_consistent") >= enough).select(*pair, F.struct(F.lit(p).alias("path"), "n_windows", "n_matched", "n_consistent").alias("way")) for df, p in ((counted, TEMPLATE), (copied, COPY))]
    leaked = ways[0].unionAll(ways[1]).groupBy(*pair).agg(F.min("way").alias("way")).select(*pair, "way.*")
    return leaked.select(F.col("id").alias(id_column), F.col("item").alias(item_column), "n_windows", "n_matched", "n_consistent", F.round(F.col("n_consistent") / F.col("n_windows"), 6).alias("share"))
