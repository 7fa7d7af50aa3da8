"""Operator 7: near-duplicate vectors by randomised-rotation binary codes and exact recomputation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.blocks import spread
from granary.llm.common import apart, apart_long, small_batches, staged, table
from granary.llm.graph import components

COSINE = 0.98
#: Vectors that a bucket has on average, about.
BUCKET = 512
#: Chance that a pair right at COSINE shares no bucket.
MISS = 1e-6
#: Bits of a code at least, and the width of the confidence bound in units of the estimate's standard deviation.
CODE_BITS = 128
WIDTH = 6.0
BLOCK = 2048
VALID = "label is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0)"


@lru_cache(maxsize=64)
def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=8)
def code_rotation(dim: int) -> np.ndarray:
    """Takes a vector, padded with zeros, to the space of its code: dim x bits with orthonormal rows."""
    return np.ascontiguousarray(rotation(max(CODE_BITS, dim), 1)[:, :dim].T)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # squares of the largest doubles overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign code of each rotated unit vector, and its correction factor: the inner product with its scaled code."""
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / math.sqrt(rotated.shape[1])


def estimate(rotated: np.ndarray, code: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of rotated vectors with coded ones, and the bound on their error."""
    bits = rotated.shape[1]
    signs = np.unpackbits(code, axis=1, count=bits).astype(np.float32) * 2 - 1
    inner = rotated.astype(np.float32) @ signs.T / math.sqrt(bits) / factor.astype(np.float32)
    return inner, WIDTH * np.sqrt((1 - factor**2) / (factor**2 * (bits - 1)))


def plan(largest: int) -> tuple[int, int]:
    """Bits of a bucket's key and the number of keys of a vector, for so many vectors of one label."""
    bits = min(30, max(1, math.ceil(math.log2(max(2, largest / BUCKET)))))
    same = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same)))


def bucket_keys(vectors: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """int32 keys, n x keys: bits of the signs of independent random rotations."""
    dim = vectors.shape[1]
    signs = np.concatenate([vectors @ rotation(dim, 100 + k) > 0 for k in range(-(-bits * keys // dim))], axis=1)[:, : bits * keys]
    return (signs.reshape(len(vectors), keys, bits) @ (1 << np.arange(bits))).astype(np.int32)


def _features(bits: int, keys: int, stored: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, lists = (c.to_pylist() for c in batch.columns)
            by: dict[int, list[int]] = {}
            for k, v in enumerate(lists):
                by.setdefault(len(v), []).append(k)
            for dim, places in by.items():
                held = np.array([lists[k] for k in places], np.float64) + 0.0
                u = unit(held)
                code, factor = codes(u @ code_rotation(dim))
                key = bucket_keys(u, bits, keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in places], pa.int64()),
                        pa.array([f"{labels[k]}:{dim}" for k in places]),
                        pa.array([hashlib.blake2b(f"{labels[k]}:{dim}".encode() + v.tobytes(), digest_size=16).hexdigest() for k, v in zip(places, held)]),
                        pa.array([v.tobytes() for v in held.astype(stored)], pa.binary()),
                        pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(factor),
                        pa.array(key.tolist(), pa.list_(pa.int32())),
                    ],
                    ["vec_id", "kind", "digest", "vector", "code", "factor", "keys"],
                )

    return run


def compare(vectors: np.ndarray, code: np.ndarray, factor: np.ndarray, keys: np.ndarray, key: int, block: np.ndarray | None):
    """Linked pairs (i, j), i < j, whose first common key is number `key`; with block only across blocks.

    Estimates decide which pairs are computed exactly, in double precision.
    """
    n = len(vectors)
    u = unit(vectors)
    rotated = u @ code_rotation(vectors.shape[1])
    left, right = [], []
    for at in range(0, n, 512):
        inner, bound = estimate(rotated[at : at + 512], code, factor)
        i, j = np.nonzero(inner + bound >= COSINE)
        i += at
        keep = i < j
        if block is not None:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        for lo in range(0, len(i), 1 << 15):
            a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
            near = np.einsum("ij,ij->i", u[a], u[b]) >= COSINE
            a, b = a[near], b[near]
            first = (keys[a, :key] != keys[b, :key]).all(axis=1)
            left.append(a[first])
            right.append(b[first])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that edges a-b reach."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            return label


def _link(stored: str):
    """Of each cell: rows (u, null, links that u gains) and rows (u, v, 0), edges that join what the links join."""

    def group(t: pa.Table):
        n = len(t)
        vectors = np.frombuffer(b"".join(t["vector"].to_pylist()), stored).reshape(n, -1)
        code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(n, -1)
        keys = np.array(t["keys"].to_pylist(), np.int32)
        block = t["block"].to_numpy() if t["crossed"][0].as_py() else None
        a, b = compare(vectors, code, t["factor"].to_numpy(), keys, t["j"][0].as_py(), block)
        if not len(a):
            return None
        ids, copies = t["vec_id"].to_numpy(), t["copies"].to_numpy()
        gained = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        who = np.flatnonzero(gained)
        root = least_reachable(n, a, b)
        tied = np.flatnonzero(root != np.arange(n))
        u = np.concatenate([ids[who], ids[tied]])
        v = pa.array(np.concatenate([ids[who], ids[root[tied]]]), mask=np.arange(len(u)) < len(who))
        return pa.RecordBatch.from_arrays([pa.array(u), v, pa.array(np.concatenate([gained[who].astype(np.int64), np.zeros(len(tied), np.int64)]))], ["u", "v", "links"])

    def of_kinds(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """A cell's rows by kind: hashes of different kinds may be one bucket."""
        for kind in t["kind"].unique():
            own = t if len(t["kind"].unique()) == 1 else t.filter(pc.equal(t["kind"], kind))
            for j in own["j"].unique():
                some = own if len(own["j"].unique()) == 1 else own.filter(pc.equal(own["j"], j))
                if len(some) > 1 and (out := group(some.combine_chunks())) is not None:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, t]) if rest is not None else t
            bucket, cell = rest["bucket"].to_numpy(), rest["cell"].to_numpy()
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
            at = 0
            for stop in edge.tolist():
                yield from of_kinds(rest.slice(at, stop - at))
                at = stop
            rest = rest.slice(at).combine_chunks()
        if rest is not None:
            yield from of_kinds(rest)

    return run


def link(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a vector of embeddings (vec_id, embedding, label).

    Vectors of one label and one length are linked when their cosine, in double precision, is COSINE or more. n_links
    counts the other vectors linked directly, component_id is the smallest vec_id that links reach, kept says that it
    is the vector's own. Equal vectors are linked and compared as one. Vectors that are null, empty, zero or hold null
    or non-finite components, and those without a label, have no links. Rows that share a vec_id count each, and share
    the smallest component of theirs. Null vec_ids are left out. Other columns are ignored; no rows give no rows.

    A pair at COSINE shares a bucket with probability 1 - MISS; keys get longer and more as a label has more vectors.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    rows = embeddings.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = rows.filter(VALID)
    largest = valid.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    bits, keys = plan(largest)
    # vectors of single precision travel as such, and lose nothing: all that is computed takes them as doubles
    stored = "<f4" if embeddings.select("embedding").schema[0].dataType.simpleString() == "array<float>" else "<f8"
    found = staged(valid.mapInArrow(_features(bits, keys, stored), "vec_id long, kind string, digest string, vector binary, code binary, factor double, keys array<int>"), "codes")
    least = found.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select(apart("digest").alias("k"), "rep", "copies")
    member = staged(found.select("vec_id", F.col("digest").alias("k")).join(least, "k"), "copies").withColumnRenamed("k", "digest")
    own = found.withColumn("k", F.col("digest")).join(least, "k").filter("vec_id = rep")
    reps = staged(own.dropDuplicates(["k"]).select("vec_id", "kind", "digest", "vector", "code", "factor", "keys", "copies"), "vectors")
    placed = reps.select("vec_id", "digest", F.posexplode("keys").alias("j", "key"), "kind").select("vec_id", "digest", "j", F.xxhash64("kind", "j", "key").alias("bucket"))
    counts = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(apart_long("bucket").alias("k"), "n")
    shared = placed.withColumn("k", F.col("bucket")).join(counts, "k").drop("k")
    full = shared.join(reps.select("digest", "kind", "vector", "code", "factor", "keys", "copies"), "digest")
    out = staged(spread(full, BLOCK, ["vec_id", "j", "kind", "vector", "code", "factor", "keys", "copies"], "vec_id").mapInArrow(_link(stored), "u long, v long, links long"), "links")
    roots = components(out.filter("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    direct = out.filter("v is null").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "rep")
    stats = staged(direct.join(roots, "rep", "full"), "stats")
    linked = member.join(stats, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    alone = rows.filter(f"not coalesce({VALID}, false)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT reach.node, p.b FROM reach JOIN p ON p.a = reach.seen
), c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
