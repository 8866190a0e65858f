"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Each stage works on every row that its predecessor kept. All but the last return the columns of ``documents``;
after mixing, a document may occur up to three times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglake.llm import langid, lines, minhash, mixing, pieces
from loglake.llm.common import drop_written, read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are near copies one occurrence stays; documents left without words go."""
    return lines.clean(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id stays."""
    return minhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, as wholes, until their sources have their target weights."""
    return mixing.resample(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become ids, with the scores of their best segmentations; decoding the ids gives the text back."""
    return pieces.encode(docs).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("source_mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

#: SQL has no compression, SimHash, MinHash or lattice search; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        # A stage's own tables go with it; what it returned goes when the next one is written.
        if k:
            drop_written(before)
    return docs
