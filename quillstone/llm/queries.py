"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import audio, fingerprint, langid, pareto, pieces, pii, quality, simhash, tokenfile, url_tree
from quillstone.llm.common import documents


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.mix(documents(spark, sf_dir))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(documents(spark, sf_dir))


def op7_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.text_media(documents(spark, sf_dir))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir))


def op8_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))
