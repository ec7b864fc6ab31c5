"""The corpus pipeline: five stages, each over all that the one before kept, with Parquet in between.

A stage's result reads tables that its operator stored. They are needed until the result is written, and go when the
next stage is called, whose documents are that written result (tables that its documents still read are kept).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import delete, discard, folders, making, shared_dir, table
from skein.llm.exact_dedup import exact_dedup
from skein.llm.language_id import known_language
from skein.llm.mixing import mixed_documents
from skein.llm.ngram_join import near_dedup
from skein.llm.packing import pack


#: The latest call of a stage: its application, its place, and the tables that its operator stored.
LATEST: list[tuple[str, int, set[str]]] = []


def tables_of(spark: SparkSession, docs: DataFrame, place: int) -> set[str]:
    """The set in which a stage's tables are to be noted. Where the call before this one was of the stage before it, what
    that one left is deleted, but for what docs still reads."""
    application = spark.sparkContext.applicationId
    if LATEST and LATEST[0][:2] == (application, place - 1):
        read = {f.rpartition("/")[2] for f in folders(docs)}
        delete(spark, [path for path in LATEST[0][2] if path.rpartition("/")[2] not in read])
    LATEST[:] = [(application, place, set())]
    return LATEST[0][2]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; a missing label is filled in."""
    with making(tables_of(spark, docs, 0)):
        return known_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    with making(tables_of(spark, docs, 1)):
        return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays, the one with the smallest id."""
    with making(tables_of(spark, docs, 2)):
        return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources come near their target weights."""
    with making(tables_of(spark, docs, 3)):
        return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences; ``row`` tells the repeats of a document apart."""
    with making(tables_of(spark, docs, 4)):
        return pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: A fitted classifier is no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k:
            discard(before)
    tables_of(spark, docs, len(STAGES))
    return docs
