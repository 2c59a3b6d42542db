"""The corpus pipeline: documents go through the stages one after the other."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import langid, linechunks, nearcopies, packing, pii
from paceline.sources.scratch import new_folder

#: Documents stay if the best language has at least this calibrated probability: short clean
#: texts are often uncertain, so only those that tell next to nothing go.
LEAST_SCORE = 0.35


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` is the length of the text a stage leaves."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the known languages go; the others stay unchanged."""
    model = langid.train(docs, ~langid.held_out())
    found = langid.predict(docs, model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)
    return found.where(known).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand earlier in the corpus go; every document stays."""
    return _with_length(linechunks.drop_repeated_chunks(docs)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    return nearcopies.drop_near_copies(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised to its kind, terms that disclose it are removed; every document stays."""
    return _with_length(pii.sanitise(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: The stages learn from the data and hash it; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of what is left of ``documents`` after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
