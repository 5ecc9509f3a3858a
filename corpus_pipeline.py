"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Rows without a doc_id pass like all others and are judged by their texts; of rows with one doc_id, and of equal rows
without any, near-dedup keeps one; empty tables stay empty; extra columns pass up to the last stage, whatever they are
called. What a stage writes for itself is deleted when the next one begins, unless that still reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, noted, remove, table
from tidemark.llm.dedup import stage_near_dedup
from tidemark.llm.langid import stage_language_id
from tidemark.llm.mixture import stage_mix
from tidemark.llm.pieces import stage_pieces
from tidemark.llm.quality import stage_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, after deleting what earlier stages of this application wrote for themselves."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        kept = remove(spark, _left.pop(app, []), docs)
        with noted() as written:
            out = stage(spark, docs, sf_dir)
        _left[app] = [*kept, *written]
        return out

    run_stage.__doc__ = stage.__doc__
    return run_stage


#: Each takes (spark, docs, sf_dir) and returns what the next one gets; all but the last keep the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("language_id", _tidy(stage_language_id)),
    ("quality", _tidy(stage_quality)),
    ("near_dedup", _tidy(stage_near_dedup)),
    ("mix", _tidy(stage_mix)),
    ("pieces", _tidy(stage_pieces)),
]

#: Compression, C-steps and sketches are not SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with noted() as written:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, before)  # the stage before this one has been read
        before = written
    return docs
