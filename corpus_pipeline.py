"""A training corpus from raw documents: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``, and mixing its slots besides, by which packing orders its sequences. A caller may write each result as Parquet and read it as the next stage's documents.

Cases, for all stages: a null or empty text, or one without a letter, goes in language ID; a null id or
source is carried, and a document with a null id is never a near copy; of repeated rows exact dedup keeps
one; other columns, also of clashing names, are carried; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm import exact_dedup, language, minhash, mixing, packing
from yieldloom.llm.common import fresh, materialize
from yieldloom.llm.queries import VOCABULARY

#: A document is rejected if it has no letters, or if no language is this likely for it.
LEAST_POSTERIOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; those without letters or a likely language go."""
    prediction, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    found = language.detect(docs, language.learn(docs), prediction, score)
    return found.where((F.col(prediction) != language.UNKNOWN) & (F.col(score) >= LEAST_POSTERIOR)).drop(prediction, score)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 and more)."""
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the slots of the mixture in a further column: in their order, sources stand at their tempered
    weights as long as they last."""
    return mixing.with_slots(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, sequences in the order of the mixture's slots: what a training run has read at any
    time holds the target weights. Without slots, in any order."""
    slot = mixing.slot_column(docs.columns)
    return packing.pack(docs, VOCABULARY) if slot is None else packing.pack_in_order(docs, slot, VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_windows),
]

#: Language ID and packing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
