"""Ranked lexical search over posting lists cut into blocks of alike documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: A-Z become a-z, digits, other letters and all bytes from 0x80 stay, every other byte parts two terms.
WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
TOP = 10
#: Bytes, terms with repeats and number of the items that are searched at once, which bounds what the driver and a task hold of them.
BATCH_BYTES, BATCH_TERMS, BATCH_ITEMS = 32 << 20, 2_000_000, 1_024
#: Documents and postings whose lists are blocked together, documents of a block, dimensions in which documents are compared for blocking.
SLAB_DOCS, SLAB_POSTINGS, BLOCK_DOCS, SKETCH = 8_192, 2_000_000, 24, 64
#: Postings that are summed up, terms of items that are looked up, and numbers of summaries that are held, at once.
AT_ONCE, CELLS = 1 << 21, 1 << 22
#: Bytes of a text that are split at once.
SLICE = 1 << 20


def split_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text of any length, slice by slice; no term is cut."""
    start = 0
    while start < len(text):
        end = min(start + SLICE, len(text))
        while end < len(text) and WORDS[text[end]] != 32:
            end += 1
        yield text[start:end].translate(WORDS).split()
        start = end


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of the docs(doc_id, text) that have terms: n counts all with repeats, terms are the numbers of those in the vocabulary, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            rows, sizes, ends, terms, tfs = [], [], [0], [], []
            for i in range(batch.num_rows):
                n, held = 0, Counter()
                for part in split_terms(texts[i].as_py() or b""):
                    n += len(part)
                    held.update(part)
                if n:
                    own = sorted((number[t], tf) for t, tf in held.items() if t in number)
                    terms += [t for t, _ in own]
                    tfs += [tf for _, tf in own]
                    rows.append(i)
                    sizes.append(n)
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<long>, tf array<long>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, terms: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """What a term adds to the score of a document of n terms that has it tf times."""
    scaled = 75 * n.astype(object) * documents // tokens if len(n) and 75 * int(n.max()) * documents >= 2**63 else 75 * n * documents // tokens
    m = (25 + scaled).astype(np.int64)
    return weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans, one span after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


class Items:
    """The items of a batch: for each its distinct terms with their multiplicity, and for each term its items."""

    def __init__(self, keys: list[int], terms: list[list[tuple[int, int]]], size: int) -> None:
        self.keys = np.array(keys, np.int64)
        self.ends = np.cumsum([0, *map(len, terms)])
        flat = [x for own in terms for x in own]
        self.terms = np.array([t for t, _ in flat], np.int64)
        self.times = np.array([k for _, k in flat], np.int64)
        self.of = np.repeat(np.arange(len(keys)), np.diff(self.ends))
        self.size = size


def sums(items: Items, rows: np.ndarray, which: np.ndarray, value) -> np.ndarray:
    """For each pair of a row and an item the sum, over the item's terms with repeats, of value(rows, terms)."""
    out = np.zeros(len(rows), np.int64)
    sizes = np.diff(items.ends)[which]
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, side="right")))
        own = sizes[begin:end]
        at = _spans(items.ends[which[begin:end]], own)
        part = value(np.repeat(rows[begin:end], own), items.terms[at]) * items.times[at]
        out[begin:end] = np.add.reduceat(part, np.cumsum(own) - own)
        begin = end
    return out


class Slab:
    """Documents whose posting lists are blocked together: rows in the order of doc_id, and their postings by row and by term."""

    def __init__(self, items: Items, doc_ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        self.items, self.doc_ids, self.starts, self.terms, self.values = items, doc_ids, starts, terms, values
        self.rows = np.repeat(np.arange(len(doc_ids)), np.diff(starts))
        self.keys = self.rows * items.size + terms
        order = np.argsort(terms, kind="stable")
        self.list_terms, first, self.list_sizes = np.unique(terms[order], return_index=True, return_counts=True)
        self.list_starts = first
        self.list_rows = self.rows[order]
        self.list_values = values[order]
        self.list_most = np.maximum.reduceat(self.list_values, first) if len(first) else first

    def scores(self, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        def value(rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
            wanted = rows * self.items.size + terms
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            return np.where(self.keys[place] == wanted, self.values[place], 0)

        return sums(self.items, rows, which, value)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the term's list, whether there is one)."""
        if not len(self.list_terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
        at = np.minimum(np.searchsorted(self.list_terms, terms), len(self.list_terms) - 1)
        return at, self.list_terms[at] == terms

    def promising(self) -> tuple[np.ndarray, np.ndarray]:
        """(item, row): for each item the documents to which one of its terms adds most. They only raise the least score that others must pass."""
        at, there = self.lists(self.items.terms)
        order = np.lexsort((-self.list_values, np.repeat(np.arange(len(self.list_terms)), self.list_sizes)))
        sizes = np.minimum(self.list_sizes[at[there]], TOP)
        rows = self.list_rows[order[_spans(self.list_starts[at[there]], sizes)]]
        pairs = _distinct(np.repeat(self.items.of[there], sizes) * len(self.doc_ids) + rows)
        return pairs // len(self.doc_ids), pairs % len(self.doc_ids)

    def essential(self, least: np.ndarray) -> np.ndarray:
        """Which of the items' terms must be looked through: the others, together, are too little for the least score that counts."""
        at, there = self.lists(self.items.terms)
        most = np.where(there, self.list_most[at] if len(self.list_most) else 0, 0) * self.items.times
        order = np.lexsort((most, self.items.of))
        held = np.cumsum(most[order])
        before = np.concatenate([[0], held])[self.items.ends[:-1]]
        enough = np.zeros(len(most), bool)
        enough[order] = held - before[self.items.of[order]] >= np.maximum(least, 1)[self.items.of[order]]
        return enough & there & (most > 0)

    def blocks(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block of each posting of the lists, list of each block): each list is cut at alike documents.

        The documents of a list are compared by a random projection of their vectors: each goes to the nearest of one centroid for ``BLOCK_DOCS`` documents.
        """
        of_post, of_block = [], []
        n = 0
        for k in lists.tolist():
            rows = self.list_rows[self.list_starts[k] : self.list_starts[k] + self.list_sizes[k]]
            centroids = -(-len(rows) // BLOCK_DOCS)
            if centroids > 1:
                points = self.sketch[rows]
                near = np.argmax(points @ points[:: BLOCK_DOCS].T, axis=1)
                used, near = np.unique(near, return_inverse=True)
            else:
                used, near = np.zeros(1), np.zeros(len(rows), np.int64)
            of_post.append(near + n)
            of_block.append(np.full(len(used), k))
            n += len(used)
        return np.concatenate(of_post), np.concatenate(of_block)

    @property
    def sketch(self) -> np.ndarray:
        """Unit vectors of the documents in ``SKETCH`` random dimensions."""
        if not hasattr(self, "_sketch"):
            x = (self.terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            at = self.rows * SKETCH + (x % np.uint64(SKETCH)).astype(np.int64)
            sign = np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
            flat = np.bincount(at, weights=self.values * sign, minlength=len(self.doc_ids) * SKETCH).reshape(-1, SKETCH).astype(np.float32)
            norm = np.linalg.norm(flat, axis=1, keepdims=True)
            self._sketch = flat / np.where(norm > 0, norm, 1)
        return self._sketch

    def summaries(self, block: np.ndarray, rows: np.ndarray, blocks: int) -> np.ndarray:
        """(block, term) -> the most that a document of the block has of the term."""
        sizes = np.diff(self.starts)[rows]
        at = _spans(self.starts[rows], sizes)
        most = np.zeros(blocks * self.items.size, np.int64)
        np.maximum.at(most, np.repeat(block, sizes) * self.items.size + self.terms[at], self.values[at])
        return most


class Best:
    """The best documents of each item so far, and the least score that another must reach."""

    def __init__(self, items: int) -> None:
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.zeros(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Null ids come last of equal scores; they are held as the largest number."""
        good = (score > 0) & (score >= self.least[item])
        item, score, doc = (np.concatenate([a, b[good]]) for a, b in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < TOP
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]
        last = place[kept] == TOP - 1
        self.least[self.item[last]] = self.score[last]


def search_slab(slab: Slab, best: Best, counted: Counter | None = None) -> None:
    """Adds the slab's documents to the best. A block is skipped only if the sum of its summary over the item's terms is below the item's least score."""
    items = slab.items
    if not len(slab.terms):
        return
    which, rows = slab.promising()
    score = slab.scores(which, rows)
    seen = np.zeros(len(items.keys) * len(slab.doc_ids), bool)  # pairs that have been scored
    seen[which * len(slab.doc_ids) + rows] = True
    best.add(which, score, slab.doc_ids[rows])
    wanted = slab.essential(best.least)
    at, _ = slab.lists(items.terms[wanted])
    lists = np.unique(at)
    if not len(lists):
        return
    block, of_block = slab.blocks(lists)
    order = np.argsort(block, kind="stable")
    members, sizes = slab.list_rows[_spans(slab.list_starts[lists], slab.list_sizes[lists])][order], np.bincount(block)
    starts = np.cumsum(sizes) - sizes
    held = np.cumsum(np.add.reduceat(np.diff(slab.starts)[members], starts))  # postings of all blocks up to one
    list_no = np.searchsorted(lists, at)
    first, many = np.searchsorted(of_block, lists), np.bincount(np.searchsorted(lists, of_block), minlength=len(lists))  # blocks stand in the order of their lists
    pair_block = _spans(first[list_no], many[list_no])
    pair_item = np.repeat(items.of[wanted], many[list_no])
    order = np.argsort(pair_block, kind="stable")
    pair_block, pair_item = pair_block[order], pair_item[order]
    begin = 0
    while begin < len(sizes):  # so many blocks at once as their summaries take memory for
        end = int(np.searchsorted(held, (held[begin - 1] if begin else 0) + AT_ONCE, side="right"))
        end = max(begin + 1, min(end, begin + CELLS // items.size))
        docs = members[starts[begin] : starts[end - 1] + sizes[end - 1]]
        most = slab.summaries(np.repeat(np.arange(end - begin), sizes[begin:end]), docs, end - begin)
        a, b = np.searchsorted(pair_block, (begin, end))
        own_block, own_item = pair_block[a:b], pair_item[a:b]
        bound = sums(items, own_block - begin, own_item, lambda rows, terms, most=most: most[rows * items.size + terms])
        order = np.argsort(-bound, kind="stable")
        own_block, own_item, bound = own_block[order], own_item[order], bound[order]
        step = max(1, AT_ONCE // (4 * BLOCK_DOCS * max(1, int(np.diff(items.ends).mean()))))
        for i in range(0, len(bound), step):
            kept = bound[i : i + step] >= np.maximum(best.least[own_item[i : i + step]], 1)
            x, q = own_block[i : i + step][kept], own_item[i : i + step][kept]
            found = np.repeat(q, sizes[x]) * len(slab.doc_ids) + members[_spans(starts[x], sizes[x])]
            found = _distinct(found[~seen[found]])
            seen[found] = True
            q, rows = found // len(slab.doc_ids), found % len(slab.doc_ids)
            best.add(q, slab.scores(q, rows), slab.doc_ids[rows])
            if counted is not None:
                counted["blocks"] += len(kept)
                counted["skipped"] += int((~kept).sum())
                counted["scored"] += len(found)
        begin = end


def _slabs(items: Items, weights: np.ndarray, documents: int, tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[Slab]:
    held, docs, posts = [], 0, 0

    def made() -> Slab:
        ids = np.concatenate([h[0] for h in held])
        sizes = np.concatenate([h[1] for h in held])
        terms, values = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(ids, kind="stable")
        at = _spans(starts[order], sizes[order])
        return Slab(items, ids[order], np.concatenate([[0], np.cumsum(sizes[order])]), terms[at], values[at])

    for batch in batches:
        ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        n, column = batch.column("n").to_numpy(), batch.column("terms")
        sizes = column.value_lengths().to_numpy()
        terms, tf = column.flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
        held.append((ids, sizes.astype(np.int64), terms, impacts(weights, terms, tf, np.repeat(n, sizes), documents, tokens)))
        docs, posts = docs + len(ids), posts + len(terms)
        if docs >= SLAB_DOCS or posts >= SLAB_POSTINGS:
            yield made()
            held, docs, posts = [], 0, 0
    if docs:
        yield made()


def search_batch(docs: DataFrame, keys: list[int], texts: list[list[bytes]]) -> DataFrame:
    """(item, doc_id, score) of the ten best documents, and ties of theirs, that each task has for each item."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in texts for t in own}))}
    vectors = checkpointed(term_vectors(docs, vocabulary))
    whole = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for row in df.toLocalIterator():  # one row a term of the batch
        weights[row.term] = weight(whole.n, row.df)
    items = Items(keys, [sorted((vocabulary[t], k) for t, k in Counter(own).items()) for own in texts], len(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = Best(len(items.keys))
        for slab in _slabs(items, weights, whole.n, whole.l, batches):
            search_slab(slab, best)
        null = best.doc == np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(items.keys[best.item]), pa.array(best.doc, mask=null), pa.array(best.score)], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item long, doc_id long, score long")


def item_batches(items: DataFrame, batch_bytes: int = BATCH_BYTES, batch_terms: int = BATCH_TERMS, batch_items: int = BATCH_ITEMS) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """(keys, terms of each) of items(item, text), taken from Spark row by row, in batches of bounded size; a longer item is a batch of its own."""
    keys: list[int] = []
    texts: list[list[bytes]] = []
    size = terms = 0
    for row in items.select("item", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text")).toLocalIterator():
        own = [t for part in split_terms(bytes(row.text)) for t in part]
        if not own:
            continue
        if keys and (size + len(row.text) > batch_bytes or terms + len(own) > batch_terms or len(keys) == batch_items):
            yield keys, texts
            keys, texts, size, terms = [], [], 0, 0
        keys.append(row.item)
        texts.append(own)
        size, terms = size + len(row.text), terms + len(own)
    if keys:
        yield keys, texts


def rank_documents(docs: DataFrame, items: DataFrame, batch_bytes: int = BATCH_BYTES, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best of docs(doc_id, text) for each of items(item_id, text).

    Terms are maximal runs of letters, digits and characters from U+0080, A-Z lower-cased. N counts the documents that have terms, L their terms, n those of one, df the documents that
    have a term. A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); with m = 25 + 75 n N div L it adds w (10^9 tf div (1000 tf + 8 m)) to the score of a document that has it tf
    times, once for each time that the item has it. Scores above 0 count.

    The items are a stated batch and go to the tasks in batches of bounded size. Documents become vectors over the batch's terms in one pass, and stay in their partitions: no text
    and no posting is shuffled, so a term that a third of all documents have is spread like the documents. A task takes them in slabs. In a slab each term's posting list is cut into
    blocks of alike documents, and a block has for each term the most that one of its documents has, so the sum of that over an item's terms is no less than the score of any of them. An
    item looks through the lists of its essential terms (a document without one of them cannot reach the ten best so far), best block first, and skips a block only if its bound is below the
    tenth score so far. Each task gives its ten best of an item, and a window the ten best of those.

    Null and empty texts, and items without terms, have no rows. Texts of any length are read whole. Equal scores are ranked by doc_id, null ids last. Repeated documents rank each, repeated items, or
    items that share an item_id, have rows each. Other columns play no part. Without documents or items there are no rows.
    """
    numbered = checkpointed(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    found = None
    for keys, texts in item_batches(numbered, batch_bytes, batch_terms):
        one = search_batch(docs, keys, texts)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= TOP)
    return best.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
