"""A training-data pipeline in five stages, each on all that the stage before it kept.

Every row of documents counts by itself, whatever its doc_id: null and repeated doc_ids, null and empty texts and repeated rows
are defined in each stage. Other columns pass through as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import decontam, jaccard, linededup, packing, quality, shared
from perigee.llm.shared import free_names, materialize, numbered, small_side

#: What the stage before has written for itself, by the thread and the input of a run, so that runs side by side keep theirs. Its
#: result has been written and reread when the next stage of its run begins.
_LEFT: dict[tuple[int, str], set[str]] = {}


def _clear(spark: SparkSession, sf_dir: str) -> None:
    shared.delete(spark, _LEFT.pop((threading.get_ident(), sf_dir), set()))


def _stage(function):
    """function, deleting first what the stage before has left in the shared folder."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark, sf_dir)
        with shared.recording() as paths:
            out = function(spark, docs, sf_dir)
        _LEFT[threading.get_ident(), sf_dir] = paths
        return out

    return run


@_stage
def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts get the score of a text without words;
    equal rows fare alike. Without labels of both kinds the score of all is their mean, 0.5 with none."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents go; n_chars follows the text. No row goes: a null text stays null, and
    a text that loses all its lines becomes empty. Equal rows fare alike."""
    return linededup.dedup(docs).select(*docs.columns)


@_stage
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies exactly one row stays, that of the smallest doc_id, null ones last; of ties any one.

    Of repeated rows one stays, and rows of one doc_id with unlike texts all do. Null texts, and texts without words, are
    in no group: they all stay.
    """
    (row,) = free_names(docs, "row")
    rows = numbered(docs, row)
    parts = jaccard.join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("at"), F.col("component_id").alias("part"))
    ids = rows.select(F.col(row).alias("at"), "doc_id").join(parts, "at")
    ids = materialize(ids.select("part", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at").alias("place")))
    groups = ids.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = materialize(ids.join(small_side(materialize(groups)), "part").where("place.at <> first.at").select(F.col("place.at").alias(row)))
    return rows.join(small_side(others), row, "left_anti").select(*docs.columns)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Null and empty texts have none and stay; equal rows fare alike."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their token ids and their places in sequences. A null or empty text
    is one piece, the end id; every row is packed, repeated ones too."""
    return packing.pack(docs)


STAGES = [("quality_classifier", accept), ("line_dedup", drop_lines), ("ngram_jaccard_join", keep_one), ("benchmark_decontamination", drop_leaks), ("packing", pack)]

#: No stage but the join can be said in SQL; a test holds run() against brute force on a small fixture, with labels of one kind.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        shared.discard(*before)
        before = [docs]
    _clear(spark, sf_dir)
    return docs
