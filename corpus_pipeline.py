"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, language, mixing, near_dup, token_output
from granary.llm.common import staged, table, work_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier accepts; those without letters or with no margin go."""
    return language.identify(docs, language.learn(docs), reject=True)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id."""
    return near_dup.deduplicate(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with an item of the benchmark."""
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic marginals."""
    return mixing.sample(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in seekable frames, and what these hold: doc_id, start, n_tokens, ids_crc32."""
    folder = work_dir(spark, "token-ids")
    return token_output.read_ids(spark, folder, token_output.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), folder))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: Compression, sketches and byte-pair encoding have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else staged(docs, name), sf_dir)
    return docs
