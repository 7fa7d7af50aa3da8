"""Operator 10: Order MinHash near-duplicates, verified by banded alignment of the words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.align import alike, similarity_bound
from granary.llm.blocks import spread
from granary.llm.common import apart, apart_long, packed, small_batches, staged, table
from granary.llm.graph import components
from granary.llm.words import U, mix, split_words, weights, windows

#: Words of a k-mer, samples of a document, minima of a sample. An edit touches two k-mers of two words at most, so a
#: fifth of the words edited, wherever, leaves the k-mers' similarity at LEAST or more; five words could leave nothing.
K = 2
#: In texts of a few words one edit touches most k-mers of two, so these are sampled by single words too: (words of a
#: k-mer, fewest and most words of a text). Lengths overlap by more than SIMILARITY lets two texts differ.
LENGTHS = ((1, 1, 15), (K, 12, None))
SHORT = 62
#: (n - 1 - 2 e) / (n - 1 + 2 e), rounded down, for e edits, a fifth of n words, and n over SHORT.
LEAST = 0.42
SAMPLES = 30
MINIMA = 2
#: One-byte minima of a document's k-mers, by which the members of a bucket are compared before any alignment.
BINS = 128
#: 1 - edits / words of the longer document.
SIMILARITY = 0.8
#: Samples whose buckets are searched first.
FIRST_SAMPLES = 8
#: Rows of a bucket that are compared in one block; larger buckets are compared block against block.
BLOCK = 2048
#: Words that the texts of a block have, about, where texts are compared; a longer text is a block of its own.
BLOCK_WORDS = 1 << 20

#: Places among which a document's words are counted; the counts bound the edits between two documents from below.
BAG = 128

FEATURES = "doc_id long, digest string, n_words int, samples array<long>, bins binary"


def labelled(kmers: np.ndarray) -> np.ndarray:
    """The k-mers, told apart by occurrence."""
    if not len(kmers):
        return kmers
    order = np.argsort(kmers, kind="stable")
    held = kmers[order]
    fresh = np.concatenate([[True], held[1:] != held[:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(held)), 0))
    out = np.empty_like(kmers)
    out[order] = mix(held + (np.arange(len(held)) - first).astype(U) * U(0x9E3779B97F4A7C15))
    return out


def order_samples(kmers: np.ndarray, samples: int, minima: int) -> np.ndarray:
    """Order MinHash: per sample the `minima` k-mers of least hash, k-mers told apart by occurrence, in text order."""
    own = labelled(kmers)
    seeds = weights(samples, 23)
    take = weights(minima, 29)
    out = np.zeros(samples, U)
    step = max(1, (1 << 18) // len(kmers))
    for at in range(0, samples, step):
        value = (own ^ seeds[at : at + step, None]) * U(0x9E3779B97F4A7C15)
        value ^= value >> U(29)
        value *= U(0xBF58476D1CE4E5B9)
        rows = np.arange(len(value))
        places = []
        for _ in range(min(minima, len(kmers))):
            places.append(value.argmin(axis=1))
            value[rows, places[-1]] = U(2**64 - 1)
        places = np.sort(np.stack(places), axis=0)
        total = seeds[at : at + step].copy()
        for j, place in enumerate(places):
            total += kmers[place] * take[j]
        out[at : at + step] = mix(total)
    return out


def bin_minima(kmers: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One byte of the least hash in each of `bins` bins, k-mers told apart by occurrence; 0 where a bin is empty."""
    value = mix(labelled(kmers) ^ U(0xD6E8FEB86659FD93))
    order = np.argsort(value)
    place = (value[order] >> U(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], place[1:] != place[:-1]])
    out = np.zeros(bins, np.uint8)
    out[place[first]] = value[order][first] % U(255) + U(1)
    return out


def bag_counts(words: np.ndarray) -> np.ndarray:
    """How many words fall to each of BAG places, as bytes that stop at 255."""
    return np.minimum(np.bincount((words >> U(57)).astype(np.int64), minlength=BAG), 255).astype(np.uint8)


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = split_words(batch.column(1))
    digests, samples, bins = [], [], []
    for lo, hi in zip(words.offsets, words.offsets[1:]):
        own = words.hashes[lo:hi]
        if len(own):
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest())
            held = [order_samples(mix(windows(own, k) + U(k)), SAMPLES, MINIMA) if fewest <= len(own) <= (most or len(own)) else np.zeros(SAMPLES, U) for k, fewest, most in LENGTHS]
            samples.append(np.concatenate(held).view(np.int64))
            bins.append(bin_minima(windows(own, min(K, len(own)))).tobytes() + bag_counts(own).tobytes())
        else:
            digests.append(None)
            samples.append(np.zeros(0, np.int64))
            bins.append(b"")
    lengths = np.concatenate([[0], np.cumsum([len(x) for x in samples])])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).cast(pa.int64()), pa.array(digests, pa.string()), pa.array(np.diff(words.offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), np.concatenate(samples)), pa.array(bins, pa.binary())],
        ["doc_id", "digest", "n_words", "samples", "bins"],
    )


def features(docs: DataFrame) -> DataFrame:
    """A row a document: a digest of its words, and its sketches; documents without words have no digest.

    samples holds SAMPLES of each of LENGTHS, 0 where a text is too long or short for them; bins the k-mers' bin
    minima, then the word counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _features(batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(run, FEATURES)


def likely(bins_a: np.ndarray, bins_b: np.ndarray) -> np.ndarray:
    """Whether the shares of equal bins leave a similarity of the k-mers of LEAST possible, which every pair within
    SIMILARITY has over SHORT words. The line lies four standard deviations of the estimate, at the most, below it.
    """
    used = ((bins_a | bins_b) != 0).sum(axis=1)
    same = ((bins_a == bins_b) & (bins_a != 0)).sum(axis=1)
    return same >= LEAST * used - 2 * np.sqrt(used)


def few_edits(bags_a: np.ndarray, bags_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether word counts leave `most` edits possible: an edit takes a word away, adds one, or does both."""
    gap = bags_a.astype(np.int16) - bags_b
    return np.maximum(np.maximum(gap, 0).sum(axis=1), np.maximum(-gap, 0).sum(axis=1)) <= most


def _likely_pairs(key: np.ndarray, block: np.ndarray, cross: np.ndarray, ids: np.ndarray, words: np.ndarray, bins: np.ndarray, comp: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely pairs of rows with one key, rows sorted by key and id, as row numbers (a, b), a part at a time: those of
    neighbours first. With comp only pairs of different components."""
    n = len(key)
    ends = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [n]])
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    alive = np.arange(n)
    shift = 1
    while len(alive := alive[alive + shift < end[alive]]):
        for at in range(0, len(alive), 1 << 14):
            a = alive[at : at + (1 << 14)]
            b = a + shift
            ok = (ids[a] != ids[b]) & (~cross[a] | (block[a] != block[b]))
            low, high = np.minimum(words[a], words[b]), np.maximum(words[a], words[b])
            ok &= high - low <= (1 - SIMILARITY) * high + 1e-9
            if comp is not None:
                ok &= comp[a] != comp[b]
            a, b = a[ok], b[ok]
            ok = few_edits(bins[a, BINS:], bins[b, BINS:], (1 - SIMILARITY) * np.maximum(words[a], words[b]) + 1e-9)
            a, b = a[ok], b[ok]
            ok = (np.maximum(words[a], words[b]) <= SHORT) | likely(bins[a, :BINS], bins[b, :BINS])
            if ok.any():
                yield a[ok], b[ok]
        shift += 1


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays share, none of them repeated. An edit takes K k-mers away at the most."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS + BAG)


def _first_partners(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
    """(a, b): of each row the pair with the first row that it is likely to equal."""
    ids, first = t["doc_id"].to_numpy(), np.full(len(t), -1)
    for a, b in _likely_pairs(key, t["block"].to_numpy(), t["crossed"].to_numpy(), ids, t["n_words"].to_numpy(), _sketches(t["bins"]), None):
        first[b] = a
    b = np.flatnonzero(first >= 0)
    a = first[b]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], ["a", "b"])


def _open_rows(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
    """(bucket, doc_id, n_words): the rows that are likely to equal one of another component."""
    found = np.zeros(len(t), bool)
    for a, b in _likely_pairs(key, t["block"].to_numpy(), t["crossed"].to_numpy(), t["doc_id"].to_numpy(), t["n_words"].to_numpy(), _sketches(t["bins"]), t["comp"].to_numpy()):
        found[a] = found[b] = True
    return t.select(["bucket", "doc_id", "n_words"]).filter(pa.array(found)).combine_chunks().to_batches()[0] if found.any() else None


def _joined(t: pa.Table, key: np.ndarray) -> pa.RecordBatch:
    """(a, b): pairs that are SIMILARITY alike, as many as join what such pairs join.

    A likely pair is aligned in the bucket of its first common sample, unless pairs before it joined its components.
    """
    ids, words, bucket = t["doc_id"].to_numpy(), t["n_words"].to_numpy(), t["bucket"].to_numpy()
    held = t["samples"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    names, comp = np.unique(t["comp"].to_numpy(), return_inverse=True)
    above = list(range(len(names)))
    texts = split_words(t["text"].combine_chunks())

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    hashes = lambda k: texts.hashes[texts.offsets[k] : texts.offsets[k + 1]]
    grams: dict[int, np.ndarray] = {}
    left, right = [], []
    for a, b in _likely_pairs(key, t["block"].to_numpy(), t["crossed"].to_numpy(), ids, words, _sketches(t["bins"]), comp):
        same = (held[a] == held[b]) & (held[a] != 0)
        here = held[a, same.argmax(axis=1)] == bucket[a]
        for i, j in zip(a[here].tolist(), b[here].tolist()):
            u, v = root(comp[i]), root(comp[j])
            if u == v:
                continue
            most = similarity_bound(words[i], words[j], SIMILARITY)
            for k in (i, j):
                if k not in grams:
                    grams[k] = np.sort(labelled(windows(hashes(k), K)))
            if common(grams[i], grams[j]) >= max(words[i], words[j]) - K + 1 - K * most and alike(hashes(i), hashes(j), most):
                above[max(u, v)] = min(u, v)
                left.append(i)
                right.append(j)
    return pa.RecordBatch.from_arrays([pa.array(ids[left], pa.int64()), pa.array(ids[right], pa.int64())], ["a", "b"]) if left else None


def _by_cell(compare, most_bytes: int = 8 << 20):
    """Rows come sorted by bucket, cell and id; whole cells of a partition, `most_bytes` of them or one, are compared
    together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(final: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            bucket, cell = t["bucket"].to_numpy(), t["cell"].to_numpy()
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
            stop = len(bucket) if final else (int(change[-1]) if len(change) else 0)
            if not stop:
                held = t.to_batches()
                return None
            key = np.zeros(stop, np.int64)
            key[change[change < stop]] = 1
            out = compare(t.slice(0, stop).combine_chunks(), np.cumsum(key))
            held = t.slice(stop).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
            return out

        waiting = most_bytes
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= waiting:
                if (out := flush(False)) is not None and out.num_rows:
                    yield out
                waiting = max(most_bytes, 2 * size)  # a cell of many batches isn't copied for each
        if held and sum(b.num_rows for b in held) and (out := flush(True)) is not None and out.num_rows:
            yield out

    return run


def _with_components(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id"))


def candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of one bucket with likely similarity: for each document of a block its first likely
    partner, so that a group's documents are linked by as many pairs as it has documents.

    members: (bucket, doc_id, n, n_words, bins), buckets of one document left out. Buckets over BLOCK rows are split in
    blocks by a hash of the id, and each pair of blocks is a group of its own, whichever task it falls to.
    """
    dealt = spread(members, BLOCK, ["doc_id", "n_words", "bins"], "doc_id")
    return dealt.mapInArrow(_by_cell(_first_partners), "a long, b long").distinct()


def remaining(members: DataFrame, comp: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that link components of comp (node, root), nodes that it lacks being their own: with them each
    likely pair of a bucket is either within one component or was aligned and found less than SIMILARITY alike.

    Pairs are aligned where they meet, and only those that join something leave the task: no more than rows. First the
    rows are found that have a likely partner in another component; only these get their texts (doc_id, text,
    samples). Blocks have BLOCK rows and BLOCK_WORDS words or so, which bounds a cell's memory.
    """
    dealt = spread(_with_components(members, comp), BLOCK, ["doc_id", "n_words", "bins", "comp"], "doc_id")
    found = dealt.mapInArrow(_by_cell(_open_rows), "bucket long, doc_id long, n_words int").distinct()
    opened = staged(found, "open")
    size = opened.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_words").cast("long")).alias("all_words")).select(apart_long("bucket").alias("k"), "n", "all_words")
    sketches = members.select("doc_id", "bins").join(opened.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    whole = _with_components(opened, comp).withColumn("k", F.col("bucket")).join(size, "k").join(sketches, "doc_id").join(texts, "doc_id")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all_words") / BLOCK_WORDS))
    return spread(whole, BLOCK, ["doc_id", "n_words", "bins", "comp", "samples", "text"], "doc_id", blocks).mapInArrow(_by_cell(_joined), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose words, aligned within the band, are SIMILARITY alike or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = split_words(batch.column(2)), split_words(batch.column(3))
            keep = []
            for k in range(batch.num_rows):
                x = left.hashes[left.offsets[k] : left.offsets[k + 1]]
                y = right.hashes[right.offsets[k] : right.offsets[k + 1]]
                keep.append(alike(x, y, similarity_bound(len(x), len(y), SIMILARITY)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    half = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = half.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept): class_id is the smallest doc_id of the document's group, kept where it is its own.

    Documents are linked when at most a fifth of the longer one's words must be inserted, deleted or replaced to get
    the other; equal word sequences are always one class. Pairs are searched by Order MinHash over k-mers of two
    words, and of one in short texts: a pair of k-mer similarity J is found with probability 1 - (1 - J^2)^30 or so
    (0.998 at 0.43, which a fifth of the words edited leaves at the least; 0.9999 at 0.52). Groups are what links
    reach. A document without words, a null text included, is a class of its own. doc_id names a document: rows with a
    null id are left out; rows that share an id get the smallest class of them. Other columns are ignored. No rows
    give no rows.
    """
    small_batches(docs.sparkSession)
    sketch = staged(features(docs), "sketches")
    # equal word sequences: one representative each, found before any bucket is made
    worded = sketch.filter("digest is not null")
    least = worded.groupBy("digest").agg(F.min("doc_id").alias("rep")).select(apart("digest").alias("d"), "rep")
    known = staged(worded.withColumn("d", F.col("digest")).join(least, "d").drop("d", "digest"), "copies")
    member = known.select("doc_id", "rep")
    reps = known.filter("rep = doc_id")
    buckets = staged(reps.select("doc_id", F.posexplode("samples").alias("j", "bucket")).filter("bucket <> 0"), "buckets")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(apart_long("bucket").alias("k"), "n")
    meeting = buckets.withColumn("k", F.col("bucket")).join(shared, "k").drop("k")
    members = staged(meeting.join(reps.select("doc_id", "n_words", "bins"), "doc_id"), "members")
    # the texts that a pair may ask for; joined by sorting at every size
    asked = members.select("doc_id").distinct().hint("merge")
    texts = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id", "left_semi"), "texts")
    tried = staged(candidates(members.filter(F.col("j") % SAMPLES < FIRST_SAMPLES)), "candidates")
    links = staged(verified(tried, texts), "links")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # then the likely pairs of a bucket whose documents are still in different components
    more = staged(remaining(members, roots, texts.join(reps.select("doc_id", "samples"), "doc_id")), "links")
    if not more.isEmpty():
        roots = components(links.unionAll(more).select(F.col("a").alias("u"), F.col("b").alias("v")))
    found = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    alone = sketch.filter("digest is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return found.unionAll(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the rows whose document isn't kept by classes(); of rows that share an id one stays.

    Rows with a null id stay. Columns are those of docs.
    """
    gone = classes(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    rows = packed(docs.filter("doc_id is not null"), id=F.col("doc_id").cast("long"), hash=F.xxhash64("text"))
    same = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    one = same.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("hash"))).filter("place = 1")
    return one.select("row.*").unionAll(docs.filter("doc_id is null"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
