"""Operator 3: greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import small_batches, table

#: Remembered words of a worker, in two generations.
MEMO_WORDS = 400_000
#: The longest word that is remembered, in characters.
WORD_MOST = 64


class Automaton:
    """Trie over a vocabulary's pieces, with failure links and the number of pieces that each link pops.

    Longest match first, from the left: while the next byte has an edge the automaton follows it; where it hasn't, the
    longest pieces that cover what was read, but for a rest that may still grow, are counted, and the link leads to the
    node of that rest. No link means that no pieces fit, and the word counts as one unknown piece. Each byte is read
    once, each link pops a piece at least: linear in the word. No piece is built.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        edges: list[dict[int, int]] = [{}]
        piece = [False]
        for word in vocabulary:
            node = 0
            for byte in word:
                following = edges[node].get(byte)
                if following is None:
                    following = len(edges)
                    edges.append({})
                    piece.append(False)
                    edges[node][byte] = following
                node = following
            piece[node] = bool(word)
        self.edges, self.link, self.popped = edges, [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in edges[parent].items():
                queue.append(node)
                if piece[node]:  # all that was read is one piece
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, count = self.link[parent], self.popped[parent]
                while at >= 0 and byte not in edges[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = edges[at][byte], count

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for byte in word:
            following = edges[node].get(byte)
            while following is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                if node == 0 and byte not in edges[0]:
                    return 1
                following = edges[node].get(byte)
            node = following
        while node > 0:
            total += popped[node]
            node = link[node]
        return total if node == 0 else 1


def byte_level(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary in a file of the tokenizers library, as bytes; special tokens left out."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(own))
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"] for t in held.get("added_tokens", [])}
    return [bytes(byte_of[c] for c in piece) for piece in held["model"]["vocab"] if piece not in special]


class Counter:
    def __init__(self, path: str):
        self.automaton = Automaton(byte_level(path))
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def words(self, text: str) -> int:
        """Pieces of a text: its words are what white space parts, each with a space before it."""
        words = text.split()
        new = set(words).difference(self.memo)
        long: dict[str, int] = {}
        if new:
            if len(self.memo) > MEMO_WORDS // 2:
                self.old, self.memo = self.memo, {}
                new = set(words)
            old, count = self.old, self.automaton.count
            for w in new:
                n = old.get(w)
                (self.memo if len(w) <= WORD_MOST else long)[w] = count(b" " + w.encode()) if n is None else n
        if long:
            return sum(long[w] if w in long else self.memo[w] for w in words)
        return sum(map(self.memo.__getitem__, words))


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_tokens: words that white space parts, and their greedy word pieces.

    Null and empty texts have none. Texts are counted whole, each row by itself. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                held = counter(path)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([len(t.split()) for t in texts], np.int64)), pa.array([held.words(t) for t in texts], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
