"""From raw documents to encoded training text: rules, duplicates, near duplicates, mix and pieces.

Each stage takes the rows that the stage before it kept, and all but the last return the columns of
``documents``; ``run`` writes them to the shared folder in between. A stage is given the written rows of the
one before, so it first deletes the files that the operator of that one settled on its way.

The stages set, for their session, how many bytes of rows Spark hands to Python at once (``BATCH_BYTES``), unless the
session has a value of its own: rows are lazy, so nothing could set it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import exact_dedup, mixing, ngram_join, piece_codec, quality
from tidepanel.llm.common import delete, discard, settle, settling, table
from tidepanel.llm.queries_native import FRACTION, LEVELS, SEED, WEIGHTS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Files that the operator of the stage before settled, by session.
_left: dict[str, list[str]] = {}
#: Bytes in a batch of rows for Python, where Spark would take 64 MB or 10,000 rows. Each worker's batch is held by the
#: JVM, outside its heap, and by the worker; the Python steps take runs of about this many bytes anyway.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", piece_codec.CHUNK_BYTES


def stage(work: Stage) -> Stage:
    @wraps(work)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        delete(spark, _left.pop(session, []))
        if spark.conf.get(BATCH_SETTING, None) is None:
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        with settling() as files:
            out = work(spark, docs, sf_dir)
        _left[session] = files
        return out

    return begin


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


@stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, LEVELS, WEIGHTS, FRACTION, SEED)


@stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_to_weights", mixing_sources),
    ("sentencepiece", encoding),
]

#: Expectation-maximisation and piece encoding have no counterpart in SQL; the tests hold the pipeline
#: against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for name, work in STAGES[:-1]:
        docs = settle(work(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
