"""Operator 8: a broadcast set of the test items' word windows; hits are verified word by word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import free_name, small_batches, staged, table
from granary.llm.words import LOWER, Words, split_words, windows

#: Words of a window.
WINDOW = 10
#: Bytes of item texts that one broadcast may hold; its index has some ten times as many in memory. Larger test sets
#: are dealt into several, of which one at a time is held.
BROADCAST_BYTES = 32 << 20


@dataclass
class Index:
    """Windows of the items as arrays: some 40 bytes a window beside the items' texts."""

    names: list[str | None]  # item ids as text
    words: Words  # of the items
    places: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by window length: hashes, sorted; items; first words

    @cached_property
    def sieves(self) -> dict[int, np.ndarray]:
        """By window length a bitmap over the low bits of the hashes; a worker makes it once."""
        out = {}
        for length, (hashes, _, _) in self.places.items():
            bits = max(16, int(len(hashes) * 32 - 1).bit_length())
            out[length] = np.zeros(1 << min(bits, 26), bool)
            out[length][hashes & np.uint64(len(out[length]) - 1)] = True
        return out

    def __getstate__(self):
        return {"names": self.names, "words": self.words, "places": self.places}

    def window(self, place: int, length: int) -> list[bytes]:
        return [LOWER[self.words.data[s:e]].tobytes() for s, e in zip(self.words.starts[place : place + length].tolist(), self.words.ends[place : place + length].tolist())]

    def holders(self, length: int, value: int, own: list[bytes]) -> set[int]:
        """The items with the window `own`, whose hash is `value`; each is verified word by word."""
        hashes, items, first = self.places[length]
        lo, hi = np.searchsorted(hashes, value), np.searchsorted(hashes, value, "right")
        return {k for k, at in zip(items[lo:hi].tolist(), first[lo:hi].tolist()) if self.window(at, length) == own}


def index_items(items: list[tuple[str | None, str]], window: int = WINDOW) -> Index:
    """Windows of `window` words of each item; an item of fewer words, but not none, is one window."""
    words = split_words(pa.array([text for _, text in items], pa.string()))
    sizes = np.diff(words.offsets)
    lengths = np.minimum(window, sizes)
    places = {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == length)
        count = sizes[own] - length + 1
        held = np.repeat(own, count)
        first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + words.offsets[held]
        hashes = windows(words.hashes, length)[first]
        order = np.lexsort((first, hashes))
        hashes, held, first = hashes[order], held[order], first[order]
        once = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (held[1:] != held[:-1])])  # an item may repeat a window
        if not once.all():
            same = [k for k in np.flatnonzero(~once).tolist()]
            once[same] = [Index([], words, {}).window(int(first[k]), length) != Index([], words, {}).window(int(first[k - 1]), length) for k in same]
        places[length] = hashes[once], held[once].astype(np.int32), first[once]
    return Index([name for name, _ in items], words, places)


def scan(words: Words, index: Index) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words of the batch lie in an occurring window, and by text the numbers of the items that occur."""
    hit = np.zeros(len(words.hashes) + 1, np.int32)
    found: dict[int, set[int]] = {}
    known: dict[tuple, set[int]] = {}
    for length, bitmap in index.sieves.items():
        run = windows(words.hashes, length)
        if not len(run):
            continue
        hashes = index.places[length][0]
        maybe = np.flatnonzero(bitmap[run & np.uint64(len(bitmap) - 1)])
        at = np.searchsorted(hashes, run[maybe])
        maybe = maybe[hashes[np.minimum(at, len(hashes) - 1)] == run[maybe]]
        text = np.searchsorted(words.offsets, maybe, "right") - 1
        inside = maybe + length <= words.offsets[text + 1]
        held_k, held = -1, []
        for i, k in zip(maybe[inside].tolist(), text[inside].tolist()):
            if k != held_k:
                held_k, held, base = k, words.words(k), int(words.offsets[k])
            own = held[i - base : i - base + length]
            key = tuple(own)
            if key not in known:
                known[key] = index.holders(length, run[i], own)
            if items := known[key]:
                hit[i] += 1
                hit[i + length] -= 1
                found.setdefault(k, set()).update(items)
    return np.cumsum(hit[:-1]) > 0, found


def slices(benchmark: DataFrame, bound: int = BROADCAST_BYTES) -> list[DataFrame]:
    """The items in parts whose texts have `bound` bytes or so, each to be broadcast by itself."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // bound) or 1
    return [items] if n == 1 else [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def mark(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, remove: str | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Mark or remove what documents share with the test items.

    remove None: a row a document with doc_id, n_words, n_hit, n_items, items_sha256 and contaminated. remove
    "documents": the rows of docs without a hit, all columns as they were. remove "spans": all rows, the text without
    the stretches from the first to the last word of each run of hit words (n_chars, if there, follows the text).

    Null and empty texts have no words and no hits. Repeated rows are judged alike, each by itself. An empty
    benchmark hits nothing. An item with a null id hits words, but isn't listed. Repeated item ids count once.
    Of the benchmark only item_id and text are read. A benchmark over `bound` bytes is dealt into parts that are
    broadcast and scanned one after the other: what a part hits is written to the shared folder, and its broadcast
    given up, before the next is made. The hit words of all parts are united. Columns of docs may have any names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = slices(benchmark, bound)
    base = docs if remove else docs.select("doc_id", "text")
    out = base
    names = list(base.columns)
    where = names.index("text")
    hits = free_name(names, "hits")
    items = free_name([*names, hits], "items")
    for number, part in enumerate(parts):
        held = spark.sparkContext.broadcast(index_items([tuple(r) for r in part.collect()], window))  # of about `bound` bytes of text
        last = number == len(parts) - 1
        if not last:
            schema = T.StructType([*base.schema.fields, T.StructField(hits, T.BinaryType()), T.StructField(items, T.ArrayType(T.StringType()))])
        else:
            schema = base.schema if remove else "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
        out = out.mapInArrow(_scanner(held, len(names), where, number, last, remove, [*names, hits, items]), schema)
        if not last:
            out = staged(out, "hits")
            held.unpersist()
    return out


def _scanner(held, width: int, where: int, number: int, last: bool, remove: str | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words = split_words(batch.column(where))
            hit, found = scan(words, index)
            items = [{index.names[i] for i in found.get(k, ())} - {None} for k in range(batch.num_rows)]
            if number:  # unite with the parts before
                bits = b"".join(batch.column(width).to_pylist())
                sizes = np.diff(words.offsets)
                whole = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool) if bits else np.zeros(0, bool)
                begin = np.concatenate([[0], np.cumsum((sizes + 7) // 8 * 8)])[:-1]
                hit |= whole[np.arange(len(hit)) + np.repeat(begin - words.offsets[:-1], sizes)] if len(hit) else hit
                items = [a | set(b) for a, b in zip(items, batch.column(width + 1).to_pylist())]
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[words.offsets[1:]] - total[words.offsets[:-1]]
            own = [batch.column(j) for j in range(width)]
            if not last:
                packed = [np.packbits(hit[a:b]).tobytes() for a, b in zip(words.offsets, words.offsets[1:])]
                yield pa.RecordBatch.from_arrays([*own, pa.array(packed, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names)
            elif remove == "documents":
                keep = pa.RecordBatch.from_arrays(own, names[:width]).filter(pa.array(n_hit == 0))
                if keep.num_rows:
                    yield keep
            elif remove == "spans":
                texts = batch.column(where).to_pylist()
                for k in np.flatnonzero(n_hit).tolist():
                    texts[k] = _without(words, hit, k)
                own[where] = pa.array(texts, batch.column(where).type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    old = own[j].to_pylist()
                    own[j] = pa.array([len(texts[k]) if n_hit[k] else old[k] for k in range(len(old))], own[j].type)
                yield pa.RecordBatch.from_arrays(own, names[:width])
            else:
                digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(words.offsets), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(n_hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def _without(words: Words, hit: np.ndarray, k: int) -> str:
    lo, hi = int(words.offsets[k]), int(words.offsets[k + 1])
    own = np.concatenate([[False], hit[lo:hi], [False]])
    edge = np.flatnonzero(own[1:] != own[:-1])
    out, at = [], int(words.bounds[k])
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(words.data[at : int(words.starts[lo + a])].tobytes())
        at = int(words.ends[lo + b - 1])
    out.append(words.data[at : int(words.bounds[k + 1])].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# An item's windows and a document's are joined on their words; the rest counts what they cover.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)
), c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id
), m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
