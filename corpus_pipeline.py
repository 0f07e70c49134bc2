"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, language_id, line_dedup, simhash, spm_codec
from larkspur.llm.common import forget, materialize, table

#: Kneser-Ney cross-entropies, BK-tree links and tokenizer ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None

OWN = "__stage_"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those that it rejects go. Models are trained on the stage's own rows.

    Null texts and texts without a letter are rejected; without any labelled row everything is. Repeated rows and ties
    fare alike, very long texts are read whole, and all columns are kept as they are.
    """
    models = language_id.train_language_models(docs)
    return language_id.identify(docs, models, prefix=OWN).where(~F.col(f"{OWN}rejected")).select(*[f"`{c}`" for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of passages of whole lines. A document of which nothing is left goes.

    Null and empty texts, and those of blank lines only, have no lines and stay. Rows with equal id and text are treated
    alike. n_chars, if there is one, follows the text; other columns are kept.
    """
    found = line_dedup.line_dedup(docs, prefix=OWN)
    left = (F.col(f"{OWN}n_removed") == 0) | (F.col(f"{OWN}n_removed") < F.col(f"{OWN}n_lines"))
    out = found.where(left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{OWN}n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: fingerprints of five-word shingles within 4 of 64 bits.

    The one of the smallest id stays, null ids last. Texts without words (null, empty) are one class. Of rows equal in id
    and text one stays, with its columns.
    """
    return simhash.keep_first(docs, shingle=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages: under a twentieth of their words in 13-word windows.

    Null and empty texts have no words and stay; an empty benchmark takes nothing; repeated rows fare alike; all columns are
    kept.
    """
    found = decontaminate.flagged(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), prefix=OWN), OWN)
    return found.where(~F.col(f"{OWN}contaminated")).select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_crc32, parity, round_trip, decoded_crc32.

    A null or empty text has no tokens; null ids and repeated rows stay; other columns go.
    """
    return spm_codec.codec_digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if i:
            forget(before)
    return docs
