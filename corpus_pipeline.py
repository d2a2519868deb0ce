"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mixing, sampled segmentation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() applies them to documents. A stage's
output is written to the shared folder and read again by the next one; it is deleted once the next one is written, the last
one when the driver ends.

In every stage an empty table gives an empty table, and columns beside id, text and source are carried along, whatever their
names. What each does with null, empty and repeated rows is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import cdc_dedup, mixing_cube, piece_sampling, quality_crf, simhash
from tidemark.llm.shared import Stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line model is fitted on a bounded sample of labelled documents.

    Null and empty texts, and those with fewer than ten words, go. Equal rows are kept or go together. Null ids and sources
    play no part. Without labels of both classes a fixed model decides.
    """
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.filter_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more.

    The document with the least id stays, null ids first, and among equal ids that with the least hash of the text. Rows with
    the same id and text are one document, of which one row stays. Null and empty texts are one group.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those with no word left by this go.

    Earlier is by id, null ids first, then by a hash of the text. Null and empty texts pass unchanged. Rows with the same id and
    text are one document and are cut alike. n_chars is brought up to date.
    """
    return cdc_dedup.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: no, one or two times each.

    Null and empty texts have no words, so they are taken or not as far as the balance of document counts goes. A null source
    is a source of its own, the last. Rows with the same id and text are there as often as all of them are taken.
    """
    return mixing_cube.mix(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, by its key: a document that is taken twice is segmented alike.

    Null and empty texts have no pieces and count as lossless. Null ids have one key. The text goes; all other columns stay.
    """
    return piece_sampling.encode(docs, piece_sampling.load())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("segmentation", segmentation),
]

#: SQL cannot express a fitted line model, balanced sampling or lattice sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = Stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.discard()
        docs, before = now.rows, now
    return STAGES[-1][1](spark, docs, sf_dir)
