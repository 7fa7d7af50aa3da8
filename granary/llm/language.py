"""Operator 5: language by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import crc_mod, small_batches, staged, table

#: Bytes of a language's dictionary, and of all together where there are many languages.
DICTIONARY_BYTES = 128 << 10
ALL_BYTES = 64 << 20
#: Documents a language's dictionary is made of, at most; those of the least id hashes, none over a quarter of it.
SAMPLE_DOCS = 400
PARTS = 64
#: Bytes that are encoded at once, so that what a long text repeats of itself doesn't hide the dictionary's part.
BLOCK = 8 << 10
LEVEL = 8
#: Shares of the second smallest size by which the smallest must lie below it.
MARGIN = 0.001

LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower case in UTF-8, its runs of ASCII characters that aren't letters each one space."""
    return b" ".join(text.lower().encode().translate(LETTERS_ONLY).split())


@dataclass
class Model:
    dictionaries: dict[str, bytes]

    def __getstate__(self):
        return {"dictionaries": self.dictionaries}

    @cached_property
    def encoders(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        out = []
        for lang, content in sorted(self.dictionaries.items()):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            out.append((lang, zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_dict_id=False)))
        return out

    def sizes(self, text: str) -> list[tuple[int, str]]:
        held = folded(text)
        blocks = [held[k : k + BLOCK] for k in range(0, len(held), BLOCK)]
        return sorted((sum(len(e.compress(b)) for b in blocks), lang) for lang, e in self.encoders)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, the margin as a share, whether it is wide enough. `und` for null or no letters, or no model."""
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        sizes = self.sizes(text)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        score = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], score, score >= MARGIN


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows (lang, far, near, doc_id, hash, size) the first SAMPLE_DOCS documents of each language."""
    held: dict[str, dict[int, tuple]] = {}
    for batch in batches:
        for lang, *row in zip(*(c.to_pylist() for c in batch.columns)):
            own, key = held.setdefault(lang, {}), row[2]
            if key not in own or tuple(row) < own[key]:
                own[key] = tuple(row)
        for lang, own in held.items():
            if len(own) > 2 * SAMPLE_DOCS:
                held[lang] = {r[2]: r for r in sorted(own.values())[:SAMPLE_DOCS]}
    rows = [(lang, *r) for lang, own in held.items() for r in sorted(own.values())[:SAMPLE_DOCS]]
    if rows:
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "far", "near", "doc_id", "hash", "size"])


def spread_out(text: bytes, most: int, pieces: int = 8) -> bytes:
    """A text, or pieces spread evenly over it that have `most` bytes together."""
    if len(text) <= most:
        return text
    size = most // pieces
    return b" ".join(text[at : at + size - 1] for at in ((len(text) - size) * k // (pieces - 1) for k in range(pieces)))


def learn(docs: DataFrame) -> Model:
    """Dictionaries from docs (doc_id, text, lang): per language the documents of the least id hashes.

    Texts of up to a quarter of DICTIONARY_BYTES come first, and are taken whole; of longer ones pieces spread over the
    text are. Null ids, null and empty texts and null languages teach nothing. Rows that share an id count as one, the
    text of the least hash. Each task keeps SAMPLE_DOCS documents a language, so that no language meets in one task;
    the driver gets the texts of the chosen ones, at most SAMPLE_DOCS a language, each up to DICTIONARY_BYTES, and the
    dictionaries have ALL_BYTES together at most.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and lang is not null and length(text) > 0")
    far, size = F.octet_length("text") > DICTIONARY_BYTES // 4, F.least(F.octet_length("text"), F.lit(DICTIONARY_BYTES))
    ranks = rows.select("lang", far.alias("far"), F.xxhash64("doc_id").alias("near"), "doc_id", F.xxhash64("text").alias("hash"), size.cast("long").alias("size"))
    order = ["far", "near", "doc_id", "hash"]
    best = staged(ranks.mapInArrow(_best, ranks.schema), "best")
    one = best.groupBy("lang", "doc_id").agg(F.min(F.struct(*order, "size")).alias("r")).select("lang", "r.*")
    # a language's best are found in parts first: tasks leave SAMPLE_DOCS each, and there may be many tasks
    part = Window.partitionBy("lang", F.pmod("near", F.lit(PARTS))).orderBy(*order)
    fewer = one.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= SAMPLE_DOCS)
    ranked = fewer.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= SAMPLE_DOCS)
    total = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    chosen = ranked.withColumn("before", F.coalesce(F.sum("size").over(total), F.lit(0))).filter(F.col("before") < DICTIONARY_BYTES).select("lang", "place", "doc_id", "hash").collect()
    languages = sorted({r.lang for r in chosen})
    if not languages:
        return Model({})
    each = min(DICTIONARY_BYTES, ALL_BYTES // len(languages))
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.lang, r.hash, r.place) for r in chosen], "doc_id long, lang string, hash long, place int")
    held = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(wanted), ["doc_id", "lang", "hash"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([spread_out(folded(t), DICTIONARY_BYTES) for t in batch.column(2).to_pylist()], pa.binary())], ["lang", "place", "content"])

    texts: dict[str, list[tuple[int, bytes]]] = {}
    folds = held.select("lang", "place", "text").mapInArrow(fold, "lang string, place int, content binary")
    for r in folds.groupBy("lang", "place").agg(F.min("content").alias("content")).collect():  # a row a chosen document
        texts.setdefault(r.lang, []).append((r.place, bytes(r.content)))
    return Model({lang: spread_out(b" ".join(t for _, t in sorted(held)), each) for lang, held in texts.items()})


def identify(docs: DataFrame, model: Model, *, reject: bool = False) -> DataFrame:
    """docs (doc_id, text) to doc_id, lang_pred, score, accepted; with reject the rows of docs that are accepted.

    Null texts and texts without letters are `und` with score 0 and not accepted. The score is the margin between the
    two smallest sizes as a share of the larger; ties go to the language that sorts first, and aren't accepted. Whole
    texts of any length are encoded in blocks. Repeated rows are judged alike. With reject all columns stay as they are.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most ALL_BYTES
    base = docs if reject else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    where = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [held.value.predict(t) for t in batch.column(where).to_pylist()]
            if reject:
                keep = batch.filter(pa.array([ok for _, _, ok in found]))
                if keep.num_rows:
                    yield keep
            else:
                langs, scores, ok = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(ok)], ["doc_id", "lang_pred", "score", "accepted"])

    return base.mapInArrow(run, base.schema if reject else "doc_id long, lang_pred string, score double, accepted boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(crc_mod("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")
