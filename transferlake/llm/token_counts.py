"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Each node also keeps how many pieces its failure pops,
so that a word's greedy longest-match length is a sum of small numbers and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices

#: Words whose length a worker remembers; beyond that it starts anew, so memory stays bounded.
REMEMBERED_WORDS = 200_000


class LongestMatch:
    """Greedy longest-match word lengths over a vocabulary of byte strings.

    ``first`` holds the pieces that may open a word and ``rest`` those that may follow. A word that
    no sequence of greedy matches covers counts as one unknown token, an empty word as none.
    """

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0 opens a word, node 1 continues it
        self.fail = [-1, -1]
        self.pops = [0, 0]
        whole = bytearray(2)
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    node = self._child(node, byte, whole)
                if piece:
                    whole[node] = 1
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for byte, v in self.edges[u].items():
                if whole[v]:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z != -1 and byte not in self.edges[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[v], self.pops[v] = self.edges[z][byte], popped
                queue.append(v)

    def _child(self, node: int, byte: int, whole: bytearray) -> int:
        child = self.edges[node].get(byte)
        if child is None:
            child = self.edges[node][byte] = len(self.edges)
            self.edges.append({})
            self.fail.append(-1)
            self.pops.append(0)
            whole.append(0)
        return child

    def length(self, word: bytes) -> int:
        edges, fail, pops = self.edges, self.fail, self.pops
        node, n = 0, 0
        for byte in word:
            while byte not in edges[node]:
                if fail[node] == -1:
                    return 1
                n += pops[node]
                node = fail[node]
            node = edges[node][byte]
        while node > 1:
            if fail[node] == -1:
                return 1
            n += pops[node]
            node = fail[node]
        return n


class WordLengths(dict):
    """Lengths of words seen so far, with the mark that opens a word put in front."""

    def __init__(self, automaton: LongestMatch, mark: bytes):
        super().__init__()
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        n = self[word] = self.automaton.length(self.mark + word)
        return n


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces of a byte-level tokenizer file: those that open a word, with its space, and the rest."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    pieces = [bytes(to_byte[c] for c in token) for token in vocabulary if all(c in to_byte for c in token)]
    return [p for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


@lru_cache(maxsize=1)
def _word_lengths(path: str) -> WordLengths:
    """One for each worker process, which takes many tasks."""
    return WordLengths(LongestMatch(*byte_level_pieces(path)), b" ")


def token_counts(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_words, n_tokens) for every row of docs, in one pass and without a shuffle.

    A word is a run of bytes other than ASCII white space. It is matched with a space in front
    against the byte-level vocabulary file, longest piece first. A null text counts as an empty one: zeros.
    Very long texts and words take time in proportion to their bytes. Repeated rows each give a row;
    other columns play no part. An empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _word_lengths(vocabulary_path)
        for batch in batches:
            sizes, words, tokens = [], [], []
            for _, texts in text_slices(batch, "text"):
                for text in texts:
                    data = text.encode()
                    split = data.split()
                    sizes.append(len(data))
                    words.append(len(split))
                    tokens.append(sum(map(lengths.__getitem__, split)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (sizes, words, tokens))], names=[id_column, "n_bytes", "n_words", "n_tokens"])

    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).mapInArrow(count, f"`{id_column}` {kind}, n_bytes long, n_words long, n_tokens long")
