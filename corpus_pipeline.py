"""A corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again.

All stages: an empty table gives an empty table; extra columns, also ones with the names of working columns, pass through all stages but
the last, which returns pieces; whole texts are read, however long; a null or repeated doc_id is a row like any other.
"""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierstone.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from tierstone.llm.util import delete_path, owned, release, table, written
from tierstone.session import ship

#: Working tables of the stage that ran last, by session, tables and thread. They go when the next stage begins, which reads a written table.
_left: dict[tuple, list] = {}


def _stage(f: Callable) -> Callable:
    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        here = (id(spark), sf_dir, threading.get_ident())
        if left := _left.pop(here, None):
            for session, path in left:
                delete_path(session, path)
            release(spark)
        with owned() as mine:
            out = f(spark, docs, sf_dir)
        _left[here] = mine
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled cutoffs reject go. Null, empty and all-white texts have no words and go; documents
    that are alike are judged alike, so all rows of a tie or a repeat stay or all go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the most code points, of these the smallest doc_id (null last), of these the
    first row. Null, empty and all-white texts are one group."""
    return exact_dedup.keep_first(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: the smallest doc_id (null last), of these the first row. Null, empty and all-white
    texts are linked with nothing and stay."""
    return ngram_join.keep_one(docs)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source; null and empty texts have size 0 and are taken with
    their neighbours in the seeded order; of rows that tie there, as many are taken as come nearest to the target."""
    return mixing.mix(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences. A null or empty text is one piece of the closing id; repeats and ties are pieces each."""
    return packing.op4(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mixing", mixed), ("best_fit_packing", packed)]

#: Token ids cannot be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
