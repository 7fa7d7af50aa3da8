"""Operator 4: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import crc_mod, small_batches, staged, table
from granary.llm.words import Words, split_words

#: Labelled documents that the classifier is fitted on, at most: those of the least id hashes.
SAMPLE_DOCS = 6000
#: Bytes that their texts have together, at most; the one that passes it is the last.
SAMPLE_BYTES = 64 << 20
#: Byte n-grams of 1 and 2 have places of their own; those of 3 and 4 share 2**HASHED.
HASHED = 17
#: Word n-grams of one word over and over: a place for each of these lengths, several so that their weight suffices.
REPEATS = (2, 3, 4, 6, 9)
REPEAT_PLACES = 8
REPEAT_START = 256 + 65536 + (1 << HASHED)
SIZE = REPEAT_START + len(REPEATS) * REPEAT_PLACES
SMOOTHING = 1.0
COST = 0.05
EPOCHS = 12
FOLDS = 4
#: Score from which 1 is predicted.
CUT = 0.3
STRETCH = 1 << 20


def present(text: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Places of the n-grams of a text's bytes; mark is scratch of SIZE falses."""
    for at in range(0, len(text), STRETCH):
        d = text[at : at + STRETCH + 3].astype(np.uint32)
        mark[d] = True
        if len(d) > 1:
            two = d[:-1] << np.uint32(8) | d[1:]
            mark[two + np.uint32(256)] = True
        if len(d) > 2:
            three = two[:-1] << np.uint32(8) | d[2:]
            mark[(three * np.uint32(0x9E3779B1) >> np.uint32(32 - HASHED)) + np.uint32(65792)] = True
        if len(d) > 3:
            four = three[:-1] << np.uint32(8) | d[3:]
            mark[((four ^ four >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - HASHED)) + np.uint32(65792)] = True
    places = np.flatnonzero(mark)
    mark[places] = False
    return places


def repeats(words: Words, k: int) -> np.ndarray:
    """Places of the lengths of n-gram that repeat one word in text k."""
    own = words.hashes[words.offsets[k] : words.offsets[k + 1]]
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
    longest = int(np.diff(edge).max()) if len(edge) > 1 else 0
    return np.concatenate([np.zeros(0, np.int64), *(REPEAT_START + j * REPEAT_PLACES + np.arange(REPEAT_PLACES) for j, n in enumerate(REPEATS) if longest >= n)])


def all_places(texts: pa.Array) -> Iterator[np.ndarray]:
    words, mark = split_words(texts), np.zeros(SIZE, bool)
    for k in range(len(texts)):
        yield np.concatenate([present(words.data[words.bounds[k] : words.bounds[k + 1]], mark), repeats(words, k)])


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares that a place has of each class's indicators."""
    counts = [np.full(SIZE, SMOOTHING), np.full(SIZE, SMOOTHING)]
    for places, label in zip(rows, y):
        counts[int(label > 0)][places] += 1
    shares = [c / c.sum() for c in counts]
    return np.log(shares[1] / shares[0])


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge loss; rows have length one after scaling by r, plus a bias of one."""
    scaled = [r[p] for p in rows]
    scaled = [x / max(np.linalg.norm(x), 1e-12) for x in scaled]
    square = np.array([x @ x + 1 for x in scaled])
    share = np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2  # classes weigh alike
    most = COST * len(rows) ** 0.5 * share
    alpha, w, bias = np.zeros(len(rows)), np.zeros(SIZE), 0.0
    random = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * scaled[i]
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1) = 1 / (1 + exp(slope * margin + shift)) by Newton steps on smoothed targets."""
    up, down = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    held = np.array([-1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(x @ held, -500, 500)))
        gradient = x.T @ (target - p) + 1e-6 * held
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        held = held - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(held[0]), float(held[1])


def margins(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    norm = [max(np.linalg.norm(r[p]), 1e-12) for p in rows]
    return np.array([w[p] @ r[p] / n + bias for p, n in zip(rows, norm)])


@dataclass
class Fitted:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        both, square = (self.ratio * self.weight).astype(np.float64), self.ratio.astype(np.float64) ** 2
        for k, p in enumerate(all_places(texts)):
            out[k] = both[p].sum() / max(np.sqrt(square[p].sum()), 1e-12) + self.bias
        return 1 / (1 + np.exp(np.clip(self.slope * out + self.shift, -500, 500)))


def fit(texts: list[str], labels: list[int]) -> Fitted:
    """From texts with labels 0 and 1; with one class only, or none, every score is that class, or a half."""
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if len(set(labels)) < 2:
        return Fitted(np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0.0, 0.0, 0.0 if not labels else -20.0 if labels[0] else 20.0)
    rows = list(all_places(pa.array(texts, pa.string())))
    fold = np.arange(len(rows)) % FOLDS
    out = np.zeros(len(rows))
    for f in range(FOLDS):  # margins for the curve come from models that haven't seen the document
        train = np.flatnonzero(fold != f)
        if len(set(y[train])) < 2:
            continue
        own = [rows[i] for i in train]
        r = ratios(own, y[train])
        w, bias = descend(own, y[train], r)
        test = np.flatnonzero(fold == f)
        out[test] = margins([rows[i] for i in test], r, w, bias)
    slope, shift = logistic(out, y)
    r = ratios(rows, y)
    w, bias = descend(rows, y, r)
    return Fitted(r.astype(np.float32), w.astype(np.float32), bias, slope, shift)


def learn(docs: DataFrame, labels: DataFrame) -> Fitted:
    """Fit on at most SAMPLE_DOCS labelled documents and about SAMPLE_BYTES, those of the least id hashes.

    Of repeated labels the largest counts, of documents that share an id the text of the least hash; so the driver gets
    a row an id, whatever is repeated. Null ids and null labels teach nothing, a null text is an empty one.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()
    if not chosen:
        return fit([], [])
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.quality, k) for k, r in enumerate(chosen)], "doc_id long, quality int, place int")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    held = staged(rows.groupBy("place", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")), "labelled")
    total, last = 0, -1
    for r in held.select("place", F.octet_length("text").alias("size")).orderBy("place").collect():
        last, total = r.place, total + r.size
        if total >= SAMPLE_BYTES:
            break
    sample = held.filter(F.col("place") <= last).orderBy("place").collect()
    return fit([r.text for r in sample], [int(r.quality > 0) for r in sample])


def classify(docs: DataFrame, model: Fitted) -> DataFrame:
    """docs (doc_id, text) to doc_id, score, predicted; null is empty, and an empty text's score is the curve at the bias.

    Repeated rows score alike, other columns are ignored, no rows give no rows. Texts are read whole, a stretch at a time.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = held.value.scores(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 5) != 0)
    return classify(docs, learn(docs, labels)).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
