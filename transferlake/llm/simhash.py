"""SimHash near-duplicates, linked through pivot distance tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, text_slices

SEED, WORDS, MAX_BITS = 42, 3, 2
#: Three references that lie 32 bits apart, each with the eight that differ from it in one byte, and random ones.
ORIGIN = xxhash.xxh64_intdigest(b"origin")
SPREAD = (ORIGIN, ORIGIN ^ 0x0F0F0F0F0F0F0F0F, ORIGIN ^ 0x3333333333333333)
RANDOM = [xxhash.xxh64_intdigest(b"pivot %d" % i) for i in range(16)]
#: Parts of a fingerprint in which references differ, and bits of each. A link changes the distances of at most two parts and leaves six as they are.
PARTS, BITS = 8, 8
#: Base in which six distances that differ by 2 at most are one number without carries.
BASE = BITS + 2 * MAX_BITS + 1
#: Pairs that are compared at once.
CHUNK = 1 << 20


def _neighbours() -> np.ndarray:
    """Differences between the cells of two linked fingerprints: one of each +/- pair, and zero.

    A cell is the distances of two parts to the three spread references. A bit of a part moves each of its three distances by one, up or down; a link has two bits at most.
    """
    bit = [(0,) * 6] + [x for signs in product((1, -1), repeat=3) for x in ((*signs, 0, 0, 0), (0, 0, 0, *signs))]
    steps = {sum((x + y) * BASE**k for k, (x, y) in enumerate(zip(a, b, strict=True))) for a in bit for b in bit}
    return np.array(sorted(d for d in steps if d >= 0))


def fingerprint(text: str) -> int:
    """64 bits: each is 1 if over half of the shingles' hashes have it.

    Shingles are three words of the text with A-Z lower-cased, repeats included; fewer words are one shingle,
    no words give zero.
    """
    words = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=False)] or [digest(joined, SEED)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long. A null text has no words."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t) for _, texts in text_slices(batch, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(made, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs a, b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked_pairs(bucket: np.ndarray, cell: np.ndarray, table: np.ndarray, fp: np.ndarray, counted: Counter | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within MAX_BITS in one bucket, in chunks; rows are distinct and sorted by (bucket, cell).

    A difference of two rows' distances to a reference bounds their Hamming distance from below. So pairs come from
    neighbouring cells only, those whose distances to a reference of the table differ by more than MAX_BITS are discarded, and the
    survivors are verified. A row of one cell meets the other cell's rows, so a chunk is bounded whatever the cells hold.
    """
    number = bucket * BASE**6 + cell
    cells, first, size = np.unique(number, return_index=True, return_counts=True)
    for step in NEIGHBOURS:
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        a = np.flatnonzero(cells[at] == cells + step)
        rows = np.arange(size[a].sum()) + np.repeat(first[a] - (np.cumsum(size[a]) - size[a]), size[a])
        other = np.repeat(at[a], size[a])
        total = np.cumsum(size[other])
        begin = 0
        while begin < len(rows):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CHUNK, side="right")))
            wide = size[other[begin:end]]
            i = np.repeat(rows[begin:end], wide)
            j = np.arange(len(i)) + np.repeat(first[other[begin:end]] - (np.cumsum(wide) - wide), wide)
            if step == 0:
                i, j = i[i < j], j[i < j]
            kept = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1, initial=0) <= MAX_BITS)
            near = kept[np.bitwise_count(fp[i[kept]] ^ fp[j[kept]]) <= MAX_BITS]
            if counted is not None:
                counted.update(candidates=len(i), kept=len(kept), linked=len(near))
            yield i[near], j[near]
            begin = end


NEIGHBOURS = _neighbours()


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each fingerprint to the first one that it reaches in its bucket; rows come sorted by bucket."""
    held = [np.zeros(0, np.int64)] * 5

    def edges(key: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        same = key[1:] == key[:-1]
        several = np.flatnonzero(np.append(same, False) | np.append(False, same))
        several = several[np.lexsort((cell[several], key[several]))]
        key, cell, fp = key[several], cell[several], fp[several].view(np.uint64)
        table = np.stack([low[several], high[several]], axis=1).astype("<i8").view(np.int8)
        bucket = np.cumsum(np.append(0, key[1:] != key[:-1])[: len(key)])
        label, left, right = np.arange(len(fp)), [], []
        for i, j in linked_pairs(bucket, cell, table, fp) if len(fp) else ():
            left.append(i)
            right.append(j)
            if sum(map(len, left)) > CHUNK:  # stars in place of pairs, so that memory follows the rows
                label = _local_labels(len(fp), np.concatenate(left), np.concatenate(right))
                left, right = [np.arange(len(fp))], [label]
        if left:
            label = _local_labels(len(fp), np.concatenate(left), np.concatenate(right))
        own = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[label[own]].view(np.int64))], names=["src", "dst"])

    for batch in batches:
        held = [np.concatenate([x, batch.column(k).to_numpy()]) for k, x in enumerate(held)]
        last = np.flatnonzero(held[0] != held[0][-1:])
        if len(last):  # the last bucket may go on in the next batch
            yield edges(*(x[: last[-1] + 1] for x in held))
            held = [x[last[-1] + 1 :] for x in held]
    yield edges(*held)


def _signed(word: int) -> int:
    return word - 2**64 if word >> 63 else word


def _distance(word: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(word))))


def distance_table(distinct: DataFrame) -> DataFrame:
    """(fp, parts, low, high): Hamming distances of each fingerprint to the references.

    parts has, by part and then by spread reference, the distance within the part: half of 8 + (distance to the reference - distance to the one that differs from it in that part). low and high have
    the distances to RANDOM, a byte each.
    """
    packed = [reduce(Column.bitwiseOR, (F.shiftleft(_distance(word).cast("long"), 8 * k) for k, word in enumerate(RANDOM[half : half + 8]))) for half in (0, 8)]
    whole = distinct.select("fp", *(_distance(r).alias(f"to{k}") for k, r in enumerate(SPREAD)), packed[0].alias("low"), packed[1].alias("high"))
    part = lambda k, r, word: F.shiftright(F.lit(BITS) + F.col(f"to{k}") - _distance(r ^ word), 1)
    masks = [((1 << BITS) - 1) << (BITS * n) for n in range(PARTS)]
    return whole.select("fp", F.array(*(part(k, r, mask) for mask in masks for k, r in enumerate(SPREAD))).alias("parts"), "low", "high")


def cells(distinct: DataFrame) -> DataFrame:
    """(bucket, cell, low, high, fp): each fingerprint of distinct(fp) once for each choice of six parts.

    bucket is the distances of those parts to the spread references, cell those of the other two parts.
    """
    table = distance_table(distinct)
    number = lambda n, base: reduce(Column.__add__, (F.element_at("parts", len(SPREAD) * n + k + 1) * F.lit(base**k) for k in range(len(SPREAD)))).cast("long")
    parts = table.select("fp", "low", "high", *(number(n, BITS + 1).alias(f"agree{n}") for n in range(PARTS)), *(number(n, BASE).alias(f"cell{n}") for n in range(PARTS)))
    size = (BITS + 1) ** len(SPREAD)
    keys = []
    for n, (i, j) in enumerate(combinations(range(PARTS), 2)):
        agree = reduce(lambda held, k: held * size + F.col(f"agree{k}"), (k for k in range(PARTS) if k not in (i, j)), F.lit(n).cast("long"))
        keys.append(F.struct(agree.alias("bucket"), (F.col(f"cell{i}") + F.col(f"cell{j}") * BASE ** len(SPREAD)).alias("cell")))
    return parts.select(F.explode(F.array(*keys)).alias("k"), "low", "high", "fp").select("k.bucket", "k.cell", "low", "high", "fp")


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs of distinct ``fp`` within MAX_BITS.

    The distances of each fingerprint to the references are computed once and go with it. Candidates are joined on them: the distances of a part to the spread references stay as they are
    unless the part has one of the at most two bits in which linked fingerprints differ, so six of eight parts agree in all of theirs. Each fingerprint goes
    to 28 buckets, one for each choice of six parts, and in a bucket meets the cells that a link can lead to.
    """
    return cells(distinct).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_link, "src long, dst long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    Fingerprints that differ in two bits or fewer are linked; component_id is the smallest id that
    can be reached, itself included. Exact copies share a fingerprint and enter the search once. Null and empty
    texts have fingerprint zero, which links like any other, and texts of any length are read whole. Links hold whatever the order of rows, so there are no ties. Rows with a null id get the smallest id reached, null if there is none; repeated
    rows each give a row; other columns play no part; an empty table gives no rows.
    """
    rows = checkpointed(fingerprints(docs, id_column, text_column))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    reached = checkpointed(connected_components(links(distinct.select("fp")).distinct()))
    members = distinct.join(reached.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    members = checkpointed(members)
    named = checkpointed(members.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = checkpointed(members.join(named, "component").select("fp", "component_id"))
    return rows.join(classes, "fp").select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
