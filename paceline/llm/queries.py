"""The registered queries of the operators for training data.

Each applies one operator, with the parameters for production, to its whole table and
derives the columns of the result from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paceline.llm import bytebpe, debruijn, digestindex, langid, linechunks, merkle, multiindex, packing, pii, quality, simhash, tokenfile, zonemaps
from paceline.sources.scratch import new_folder

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digest(_read(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-file")
    tokenfile.write_token_file(_read(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2)
    return tokenfile.read_token_file(spark, path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digest(_read(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_read(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_read(spark, sf_dir, "documents"), WORD_BPE, end_id=1))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_read(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.digest(_read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_read(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.digest(_read(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digestindex.digest(_read(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1,
    "op2_pii": op2,
    "op3_substring_dedup": op3,
    "op4_token_file": op4,
    "op5_byte_bpe": op5,
    "op6_language_id": op6,
    "op7_best_fit_packing": op7,
    "op8_quality_rules": op8,
    "op9_line_dedup": op9,
    "op10_simhash_near_dedup": op10,
    "op11_centroid_clustering": op11,
    "op12_exact_dedup": op12,
    "op13_merkle_manifest": op13,
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": multiindex.ORACLE,
    "op3_substring_dedup": debruijn.ORACLE,
    "op11_centroid_clustering": zonemaps.ORACLE,
    "op12_exact_dedup": digestindex.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
