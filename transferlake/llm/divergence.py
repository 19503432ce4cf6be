"""Source divergence audit: term frequencies by single-pass in-memory indexing, then exact divergences of sources."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import new_folder
from .common import checkpointed

#: A-Z become a-z, other letters and all bytes from 0x80 stay, every other byte parts two terms.
LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
#: Distinct (lang, source, term) that a block of postings holds; about 150 MB.
BLOCK_POSTINGS = 500_000
#: Postings of one packed piece of a run, and runs that one merge takes at most.
PIECE, FAN_IN = 1_024, 2_048
#: Bytes of a text that are split at once.
SLICE = 1 << 20
LEAST_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text of any length, slice by slice; no term is cut."""
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        while end < len(text) and LETTERS[text[end]] != 32:
            end += 1
        yield text[start:end].translate(LETTERS).split()
        start = end


class _Block:
    """Postings held in memory: for each (lang, source) the occurrences of its terms and the documents that have them."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        cf, df = self.groups.setdefault(group, (Counter(), Counter()))
        before, terms = len(cf), set()
        for part in term_slices(text):
            cf.update(part)
            terms.update(part)
        df.update(terms)
        self.size += len(cf) - before

    def run(self, shards: int) -> Iterator[tuple]:
        """(shard, lang, first term, payload) of a term-sorted run, in pieces; each group stands once more under the empty term, so that it occurs even without terms."""
        for lang in sorted({g[0] for g in self.groups}):
            names = sorted(s for x, s in self.groups if x == lang)
            by_shard: list[list] = [[] for _ in range(shards)]
            by_shard[0] += [(b"", k, 0, 0) for k in range(len(names))]
            for k, name in enumerate(names):
                cf, df = self.groups[lang, name]
                for term, n in cf.items():
                    by_shard[zlib.crc32(term) % shards].append((term, k, n, df[term]))
            for shard, entries in enumerate(by_shard):
                entries.sort()
                for start in range(0, len(entries), PIECE):
                    yield shard, lang, entries[start][0], pack(names, entries[start : start + PIECE])


def pack(names: list[str], entries: list[tuple[bytes, int, int, int]]) -> bytes:
    """Sorted (term, number of the source, occurrences, documents) as bytes; terms and names hold no newline or are escaped."""
    used = sorted({e[1] for e in entries})
    number = {k: i for i, k in enumerate(used)}
    words = b"\n".join(e[0] for e in entries)
    sources = b"\0".join(names[k].encode().replace(b"\1", b"\1\1").replace(b"\0", b"\1\2") for k in used)
    numbers = np.array([(number[e[1]], e[2], e[3]) for e in entries], "<i8").tobytes()
    return zlib.compress(len(words).to_bytes(4, "little") + len(sources).to_bytes(4, "little") + words + sources + numbers, 1)


def unpack(payload: bytes) -> tuple[list[bytes], list[str], list[list[int]]]:
    raw = zlib.decompress(payload)
    a, b = 8 + int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    names = [s.replace(b"\1\2", b"\0").replace(b"\1\1", b"\1").decode() for s in raw[a : a + b].split(b"\0")]
    return raw[8:a].split(b"\n"), names, np.frombuffer(raw, "<i8", offset=a + b).reshape(-1, 3).tolist()


def sorted_runs(docs: DataFrame, shards: int, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(run, shard, lang, first, payload): the runs of docs(lang, source, text), which are read once."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 20
        block, n = _Block(), 0

        def spilled() -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for piece in block.run(shards):
                held.append((task + n, *piece))
                if len(held) == 512:
                    yield _rows(held)
                    held = []
            if held:
                yield _rows(held)

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                block.add((lang, source), texts[i].as_py() or b"")
                if block.size >= block_postings:
                    yield from spilled()
                    block, n = _Block(), n + 1
        yield from spilled()

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return read.mapInArrow(index, RUN)


RUN = "run long, shard int, lang string, first binary, payload binary"
_RUN = pa.schema([("run", pa.int64()), ("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("payload", pa.binary())])
_MERGED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("postings", pa.list_(pa.struct([("source", pa.string()), ("count", pa.int64())])))])
MERGED = "lang string, term string, total long, postings array<struct<source:string,count:long>>"


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _RUN, strict=True)], schema=_RUN)


def heap_merge(pieces: Iterator[tuple[tuple, bytes, bytes]]) -> Iterator[tuple[tuple, bytes, dict[str, list[int]]]]:
    """(key, term, {source: [occurrences, documents]}) in order, from (key, first term, payload) in the order of key and first term.

    A piece is opened only when its first term is due, so that at most one piece of each run is open. Its next term stands in a heap.
    """
    heap: list[tuple] = []  # (term, number of the piece, place in it, piece)
    coming = next(pieces, None)
    opened, key = 0, None
    while heap or coming:
        if not heap:
            key = coming[0]
        while coming and coming[0] == key and (not heap or coming[1] <= heap[0][0]):
            piece = unpack(coming[2])
            heappush(heap, (piece[0][0], opened, 0, piece))
            opened, coming = opened + 1, next(pieces, None)
        term, found = heap[0][0], {}
        while heap and heap[0][0] == term:
            _, number, at, piece = heap[0]
            words, names, numbers = piece
            while at < len(words) and words[at] == term:
                source, cf, df = numbers[at]
                held = found.setdefault(names[source], [0, 0])
                held[0] += cf
                held[1] += df
                at += 1
            if at < len(words):
                heapreplace(heap, (words[at], number, at, piece))
            else:
                heappop(heap)
            while coming and coming[0] == key and coming[1] == term:  # the same term goes on in a run's next piece
                piece = unpack(coming[2])
                heappush(heap, (piece[0][0], opened, 0, piece))
                opened, coming = opened + 1, next(pieces, None)
        yield key, term, found


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bytes]]:
    for batch in batches:
        for group, shard, lang, first, payload in zip(*(batch.column(c).to_pylist() for c in ("bundle", "shard", "lang", "first", "payload")), strict=True):
            yield (group, shard, lang), first, payload


def _merge_bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of a bundle as one."""
    held: list[tuple] = []
    entries: list[tuple] = []
    names: dict[str, int] = {}
    at = None

    def piece() -> tuple:
        order = list(names)
        return at[0], at[1], at[2], entries[0][0], pack(order, entries)

    for key, term, found in heap_merge(_in_order(batches)):
        if entries and (key != at or len(entries) >= PIECE):
            held.append(piece())
            entries, names = [], {}
        at = key
        entries += [(term, names.setdefault(s, len(names)), *found[s]) for s in sorted(found)]
        if len(held) >= 512:
            yield _rows(held)
            held = []
    if entries:
        held.append(piece())
    if held:
        yield _rows(held)


def _merge_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies of the terms that enough documents of a language have, and the groups under the empty term."""
    rows: list[tuple] = []
    for (_, _, lang), term, found in heap_merge(_in_order(batches)):
        if not term or sum(df for _, df in found.values()) >= LEAST_DOCS:
            rows.append((lang, term.decode(), sum(cf for cf, _ in found.values()), [{"source": s, "count": found[s][0]} for s in sorted(found)]))
        if len(rows) == 4_096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MERGED, strict=True)], schema=_MERGED)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MERGED, strict=True)], schema=_MERGED)


def term_frequencies(docs: DataFrame, block_postings: int = BLOCK_POSTINGS, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, term, total, postings) of docs(lang, source, text): the terms in at least ``LEAST_DOCS`` documents of the lang, with occurrences in all and by source; the empty
    term has every occurring source.

    Each task reads its documents once and holds the postings of a block until ``block_postings`` of them fill its memory; then the block leaves as a run sorted by
    term, in packed pieces by hash shard of the term. The runs of a shard meet in one task, where a heap merges them, ``fan_in`` at a time: with more
    runs than that, bundles of runs are merged to one run each first. Memory is a block, or one piece a run; a frequent term costs a
    posting a run and source, however often it occurs.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = checkpointed(sorted_runs(docs, 2 * tasks, block_postings))
    while (count := runs.select("run").distinct().count()) > fan_in:
        bundles = -(-count // fan_in)
        dealt = runs.select(F.pmod(F.xxhash64("run"), F.lit(bundles)).alias("bundle"), "shard", "lang", "first", "payload").repartition(tasks, "bundle", "shard")
        runs = checkpointed(dealt.sortWithinPartitions("bundle", "shard", "lang", "first").mapInArrow(_merge_bundle, RUN))
    dealt = runs.select(F.lit(0).cast("long").alias("bundle"), "shard", "lang", "first", "payload").repartition(tasks, "shard")
    return dealt.sortWithinPartitions("shard", "lang", "first").mapInArrow(_merge_last, MERGED)


def scaled_share(count: Column, size: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (size + kept)), exactly: the product is a decimal, since it can pass 2^63."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(11,0)") * (count + 1).cast("decimal(20,0)"), (size + kept).cast("decimal(20,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(docs: DataFrame, block_postings: int = BLOCK_POSTINGS, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text): how far a source's words are from another's, and which words set it apart.

    Terms are maximal runs of letters and characters from U+0080, A-Z lower-cased. A lang keeps those in at least 3 of its documents; V is their number. A group (lang,
    source), and the lang as a whole, gives a kept term p = 1 + floor(10^9 (count + 1) / (N + V)), N being the sum of its counts; a divergence of p from q is floor((p - q)^2 / q).
    Part ``pair`` has for each group every other source of the lang with the sum over all kept terms, q being the other's p; part ``term`` has the kept
    terms that a group has and that have p > q, q being the lang's, to rank 200. Ranks count from 1 within group and part, by value descending, then item.

    Frequencies come from ``term_frequencies``. A pair's sum is never taken over its terms: all V terms count as if neither group had them, then the terms that one has are
    corrected from the histogram of its counts, and those that both have from the joint one, which is streamed from each term's own postings and combined
    before it is shuffled. No vocabulary meets in one task; groups as large as a third of all rows are histograms like any other.

    Null text, lang and source are '' and so are a group of their own. Empty texts make their group occur. Repeated rows count each. Texts of any length are read
    whole, slice by slice. Equal values are ranked by the bytes of item. Other columns, doc_id among them, play no part; an empty table gives no rows; a lang of one source gives no
    pairs, one without kept terms only pairs of value 0.
    """
    spark = docs.sparkSession
    merged = checkpointed(term_frequencies(docs, block_postings, fan_in))
    terms = merged.where("term <> ''")
    posted = terms.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", "x.source", "x.count")
    counts = checkpointed(posted.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")))
    sizes = counts.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = merged.where("term = ''").select("lang", F.explode("postings.source").alias("source")).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    path = new_folder(spark, "groups")  # as a file, so that the planner knows its size
    groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "lang_n"))).write.parquet(path)
    groups = spark.read.parquet(path)

    p = scaled_share(F.col("count"), F.col("n"), F.col("v"))
    q = scaled_share(F.col("total"), F.col("lang_n"), F.col("v"))
    own = posted.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    words = own.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", place).where(F.col("rank") <= RANKS)

    side = lambda x, df: df.select("lang", *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("lang", "v", "lang_n")), *([F.col("v")] if x == "a" and "v" in df.columns else []))
    pairs = side("a", groups).join(side("b", groups), "lang").where("source_a <> source_b")
    share = lambda count, x: scaled_share(count, F.col(f"n_{x}"), F.col("v"))
    none = F.lit(0).cast("long")
    neither = F.when(F.col("v") > 0, F.col("v") * divergence(share(none, "a"), share(none, "b"))).otherwise(none)
    key = ("lang", "source_a", "source_b")
    base = pairs.select(*key, neither.alias("value"))
    single = []
    for x, other in (("a", "b"), ("b", "a")):
        had = pairs.join(counts.select("lang", F.col("source").alias(f"source_{x}"), "count", "terms"), ["lang", f"source_{x}"])
        ends = {x: share(F.col("count"), x), other: share(none, other)}
        single.append(had.select(*key, (F.col("terms") * (divergence(ends["a"], ends["b"]) - divergence(share(none, "a"), share(none, "b")))).alias("value")))
    ordered = F.filter("postings", lambda y: y["source"] > F.col("a.source"))
    both = terms.where(F.size("postings") > 1).select("lang", "postings", F.explode("postings").alias("a")).select("lang", "a", F.explode(ordered).alias("b"))
    joint = both.groupBy("lang", F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"), F.col("a.count").alias("count_a"), F.col("b.count").alias("count_b")).agg(F.count("*").alias("terms"))
    joint = checkpointed(joint)
    turned = joint.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("count_b").alias("count_a"), F.col("count_a").alias("count_b"), "terms")
    met = pairs.join(joint.unionAll(turned), list(key))
    pa_, pb_, a0, b0 = share(F.col("count_a"), "a"), share(F.col("count_b"), "b"), share(none, "a"), share(none, "b")
    double = met.select(*key, (F.col("terms") * (divergence(pa_, pb_) - divergence(pa_, b0) - divergence(a0, pb_) + divergence(a0, b0))).alias("value"))
    value = base.unionAll(single[0]).unionAll(single[1]).unionAll(double).groupBy(*key).agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    sources = value.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value").withColumn("rank", place)
    return sources.unionAll(words)
