"""From raw documents to packed sequences, in five stages over everything the stage before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from tessera.llm.common import Workspace, delete, shared_path, ship, store
from tessera.llm.queries import JSON_50K

NEAR = 0.8
REPEAT_BYTES = 50
SEQUENCE = 1024
END = 2


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """A stage starts when the one before is written, so what that one left in the shared folder goes."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        Workspace.finish(spark)
        with Workspace.recorded(spark):
            return work(spark, docs, sf_dir)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts with no letter (null and empty ones too) or without one main language.

    Rows are judged one by one, with or without an id; repeated rows share
    their fate, other columns stay as they are, an empty table stays empty.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks the longest stays, then the one with the smallest id, null last.

    Null counts as empty. A row goes by its own id and text; rows repeated
    with the id that stays, stay. Other columns stay as they are.
    """
    return exact_dedup.drop_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest id, null last.

    Texts without words (null and empty ones too) are near nothing. A row goes
    by its own id and text. Other columns stay as they are.
    """
    return near_dedup.drop_near(docs, NEAR)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out what documents with smaller ids also hold; a document goes if nothing but blanks is left.

    Null texts come back empty. Every row keeps its own text and its other
    columns, but for n_chars, which is counted anew.
    """
    kept = suffix_dedup.cut(docs, REPEAT_BYTES)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places; null texts have their end only, repeated rows are packed each."""
    return packing.pack(docs, JSON_50K, SEQUENCE, END)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: SQL has neither the signatures nor the tokenizer; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{i}")
            store(docs, path)
            docs = spark.read.schema(docs.schema).parquet(path)
            for before in written:
                delete(spark, before)
            written = [path]
    return docs
