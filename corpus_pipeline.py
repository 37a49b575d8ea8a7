"""From raw documents to token ids: language, lines, near duplicates, mix, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratastats.llm import curriculum, language, lines, neardup, pieces
from stratastats.llm.queries import PIECE_MODEL, weight_of
from stratastats.sources import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus itself teaches; those without a letter go."""
    model = language.train(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = language.with_language(docs.select(row, "text"), model)
    return found.filter(F.col("lang_pred") != language.NONE).select("_row.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the last of them only.

    Null and empty texts stay as they are; an empty table gives none.
    """
    return lines.cleaned(docs, lines.keep_bitmaps(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Of rows that repeat an id one stays; rows without an id all stay.
    """
    return neardup.kept_rows(docs, neardup.components(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a document that is used twice comes twice.

    Texts without a word have no size and are used as long as their source's target allows.
    """
    return curriculum.mixed(docs, curriculum.plan(docs, weight_of, volume=1.5, most=2.0))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, and the digest of the text that they decode to.

    A null text is an empty one; equal rows stay.
    """
    return pieces.encode(docs, public_tokenizers.path(PIECE_MODEL), check=True)


STAGES = [
    ("language", identified),
    ("line_dedup", without_common_lines),
    ("near_duplicates", without_near_copies),
    ("mix", mixed),
    ("tokens", tokenised),
]

# The language model, MinHash and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
