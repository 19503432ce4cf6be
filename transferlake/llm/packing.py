"""Order-preserving packing of tokenised documents by dynamic programming.

The documents of an input partition form one stream of tokens in their order. Places where the stream
may be cut are ends of documents, ends of sentences and, in very long sentences, every FREE_STEP tokens.
A dynamic programme picks the cuts that cost least: padding of each window plus a penalty for each
document that a cut splits. A window of length L pads to the window size, except that a length which is a power of
two is not padded. The transition over all earlier places within a window is the minimum of
``cost + position`` over a sliding range, kept in a monotone queue; the few unpadded lengths are
looked up by position.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import text_slices

WINDOW = 1024
#: Costs in tokens of padding.
SENTENCE_CUT, FREE_CUT = 4, 24
FREE_STEP = 64
#: Tokens of the stream that one dynamic programme covers.
BLOCK_TOKENS = 1 << 17
#: The published split pattern of this family of byte-level tokenizers.
SPLIT = r" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Bytes of a run of white space, or of anything else, beyond which a text goes to the tokenizer itself: merges by rank take
#: time in the square of a run.
LONG_RUN = 2_000
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _printable_bytes() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def merges_by_rank(path: str) -> bool:
    """Whether merging the two neighbours whose union has the smallest id gives the ids of this tokenizer file.

    It does if the merges stand in the order of the ids that they make, every token of the vocabulary is the only id of its own text,
    and texts are split by the published pattern and nothing else: a run of bytes that is merged into one token has been
    merged as that token's own text is, since no merge of a smaller id crosses its ends.
    """
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, split = parts["model"], parts["pre_tokenizer"] or {}
    plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    if model["type"] != "BPE" or any((model.get(k) or None) != (v or None) for k, v in plain.items()) or parts["normalizer"] or parts["post_processor"]:
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    pieces = Tokenizer.from_file(path).model
    return made == sorted(set(made)) and all([t.id for t in pieces.tokenize(token)] == [i] for token, i in model["vocab"].items())


class Ids:
    """Ids of texts by a byte-level tokenizer file.

    With ``by_rank`` (see ``merges_by_rank``) they come from the faster merge by rank; texts with the string of an added token or
    a very long run go to the tokenizer itself.
    """

    def __init__(self, path: str, by_rank: bool):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        vocabulary, byte = parts["model"]["vocab"], _printable_bytes()
        self.path, self.by_rank, self.added = path, by_rank, [t["content"] for t in parts["added_tokens"]]
        if by_rank:
            ranks = {bytes(map(byte.__getitem__, token)): i for token, i in vocabulary.items()}
            self.ranked = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(1 + max([0, *vocabulary.values(), *(t["id"] for t in parts["added_tokens"])]), bool)
        for token, i in vocabulary.items():
            self.ends[i] = token[-1:] in (".", "!", "?", "Ċ") or any(c in token for c in (".Ċ", "!Ċ", "?Ċ"))

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def of(self, text: str) -> np.ndarray:
        if not self.by_rank or any(t in text for t in self.added) or (len(text) > LONG_RUN and self._has_long_run(text)):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranked.encode_to_numpy(text, disallowed_special=())

    @staticmethod
    def _has_long_run(text: str) -> bool:
        space = IS_SPACE[np.frombuffer(text.encode(), np.uint8)]
        return int(np.diff(np.flatnonzero(space[1:] != space[:-1]), prepend=-1, append=len(space) - 1).max()) > LONG_RUN


@lru_cache(maxsize=1)
def _ids(path: str, by_rank: bool) -> Ids:
    """One for each worker process, which takes many tasks."""
    return Ids(path, by_rank)


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a stream of ids may be cut and what each cut costs, 0 and the end included."""
    price = np.full(len(ids) + 1, -1, np.int64)
    price[1:][sentence_end[ids]] = SENTENCE_CUT
    price[0] = 0
    price[doc_ends] = 0
    at = np.flatnonzero(price >= 0)
    gaps = np.diff(at)
    if len(wide := np.flatnonzero(gaps > FREE_STEP)):
        extra = np.concatenate([np.arange(at[k] + FREE_STEP, at[k + 1], FREE_STEP) for k in wide])
        price[extra] = FREE_CUT
        at = np.flatnonzero(price >= 0)
    return at, price[at]


def best_cuts(at: np.ndarray, price: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indices into ``at`` of the cheapest cuts, first and last place included.

    cost(i) = price(i) + min over j of cost(j) + padding(at(i) - at(j)), at(i) - at(j) <= window.
    """
    index = np.full(int(at[-1]) + 1, -1)
    index[at] = np.arange(len(at))
    # Earlier places at the distance of a power of two: those of place i stand at starts[i] up to starts[i + 1].
    powers = 1 << np.arange(window.bit_length() - 1)
    earlier = np.where(at[:, None] >= powers, index[np.maximum(at[:, None] - powers, 0)], -1)
    starts = np.cumsum(np.append(0, (earlier >= 0).sum(axis=1))).tolist()
    exact = earlier[earlier >= 0].tolist()
    places, prices = at.tolist(), price.tolist()
    cost, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, index), increasing
    for i in range(1, len(places)):
        p = places[i]
        while queue[0][1] < p - window:
            queue.popleft()
        least, _, j = queue[0]
        best = least + window - p
        for k in exact[starts[i] : starts[i + 1]]:
            if cost[k] < best:
                best, j = cost[k], k
        best += prices[i]
        cost[i], back[i] = best, j
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, i))
    cuts = [len(places) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def padding(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Padded tokens of sequences of these lengths."""
    lengths = np.asarray(lengths, np.int64)
    return np.where(lengths & (lengths - 1) == 0, 0, window - lengths)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is the ids of its text (null: empty) and then id 0. Its pieces follow each other in
    consecutive sequences of at most ``window`` tokens; every id lies in one piece, offsets in a sequence have no
    gaps. Documents keep the order in which Spark reads them within a partition; partitions are packed
    apart, and sequence_id is unique over all of them. The last tokens of a partition are cut into powers of two. Empty
    and null texts give one piece of one id; repeated rows are packed each; an empty table gives no rows.
    Memory holds one block of BLOCK_TOKENS ids and one batch, however many documents there are. No shuffle.
    """
    kind, by_rank = docs.schema[id_column].dataType.simpleString(), merges_by_rank(tokenizer_path)
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _ids(tokenizer_path, by_rank)
        base, made = TaskContext.get().partitionId() << 40, 0
        held: list[tuple[object, np.ndarray, int, int]] = []  # id, tokens not yet placed, their start, tokens of the whole
        count = 0
        id_type = None

        def place(last: bool) -> pa.RecordBatch:
            nonlocal held, count, made
            stream = np.concatenate([x[1] for x in held])
            ends = np.cumsum([len(x[1]) for x in held])
            at, price = cut_places(stream, ends, ids_of.ends)
            cuts = at[best_cuts(at, price, window)]
            if last:  # the tail in powers of two
                tail = list(cuts[:-1])
                while tail[-1] < cuts[-1]:
                    tail.append(tail[-1] + min(window, 1 << (int(cuts[-1] - tail[-1]).bit_length() - 1)))
                cuts = np.array(tail)
            else:  # the last window may yet grow
                cuts = cuts[:-1]
            done, bounds = cuts[-1], np.unique(np.concatenate([cuts, ends[ends <= cuts[-1]]]))
            firsts, sizes = bounds[:-1], np.diff(bounds)
            doc = np.searchsorted(ends, firsts, side="right")
            seq = np.searchsorted(cuts, firsts, side="right") - 1
            starts = ends - np.array([len(x[1]) for x in held])
            raw = stream.astype("<u4").tobytes()
            crc = [crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]
            own = np.array([x[2] for x in held])
            columns = [pa.array([held[d][0] for d in doc], id_type), *(pa.array(x, pa.int64()) for x in (firsts - starts[doc] + own[doc], sizes, crc, np.array([x[3] for x in held])[doc], base + made + seq, firsts - cuts[seq]))]
            made += len(cuts) - 1
            first = int(np.searchsorted(ends, done, side="right"))
            rest = held[first:]
            if rest:
                skip = int(done - starts[first])
                i, tokens, start, whole = rest[0]
                rest[0] = (i, tokens[skip:], start + skip, whole)
            held, count = rest, int(ends[-1] - done)
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for start, texts in text_slices(batch, "text", 400_000):
                for k, text in enumerate(texts):
                    tokens = np.append(ids_of.of(text), np.uint32(0))
                    held.append((batch.column("id")[start + k].as_py(), tokens, 0, len(tokens)))
                    count += len(tokens)
                    if count >= BLOCK_TOKENS:
                        yield place(last=False)
        if held:
            yield place(last=True)

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(pack, f"`{id_column}` {kind}, {SCHEMA}")
