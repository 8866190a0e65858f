"""The registered queries of this subpackage, one per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import describe

    return describe(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup

    return dedup(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).drop("source")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import groups

    return groups(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import detect

    return detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode

    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup,
            op2_language_id,
            op3_media_columns,
            op4_line_dedup,
            op5_quality_rules,
            op6_mixing,
            op7_minhash,
            op8_toxicity,
            op9_suffix_array_dedup,
            op10_sentencepiece,
            pipeline,
        )
    }


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
