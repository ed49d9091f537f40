"""A corpus from raw documents to packed sequences.

Every stage takes the session, the documents its predecessor kept, and the folder of
the tables, and returns a table that is written and read again before the next. All but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.common import written
from docketry.llm.exact import without_exact_duplicates
from docketry.llm.language import with_language
from docketry.llm.mixing import mixed_documents
from docketry.llm.nearcopies import without_near_copies
from docketry.llm.packing import packed_pieces
from docketry.sources.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language stays in doubt, go."""
    return with_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return without_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of texts with a shingle similarity of 0.8 or more the one with the smallest id stays.

    Candidates are the classes of SimHash fingerprints that BK-trees link, and equal bands of min-hashes for pairs whose
    fingerprints lie further apart; an exact count over the whole shingle sets follows.
    """
    return without_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or left out so that their sources come near their targets."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packed_pieces(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

ORACLE_SQL = None  # language identification and packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
