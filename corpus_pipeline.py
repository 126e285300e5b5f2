"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Language ID drops texts without a language; the n-gram join leaves one document of each group of near
copies; decontamination drops documents that hold a benchmark item; mixing repeats or leaves out whole
documents until the sources have their weights; sharding deals out what is left. All but the last
return the columns of their input; that one returns each row's doc_id, size, CRC, shard and slot.
Null, empty, repeated and long texts, and empty tables, come out as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm.common import accounted, delete, table
from cellweave.llm.decontaminate import without_leaks
from cellweave.llm.language_id import keep_identified
from cellweave.llm.mixing import mixed_rows
from cellweave.llm.ngram_join import one_of_each_group
from cellweave.llm.sharding import shard_documents
from cellweave.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the stage before has staged; its result is written when the next one begins.
_before: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _before)
        with accounted() as paths:
            out = work(spark, docs, sf_dir)
        _before.extend(paths)
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _stage(lambda spark, docs, sf_dir: keep_identified(docs))),
    ("ngram_join", _stage(lambda spark, docs, sf_dir: one_of_each_group(docs))),
    ("decontamination", _stage(lambda spark, docs, sf_dir: without_leaks(docs, table(spark, sf_dir, "benchmark")))),
    ("mixing", _stage(lambda spark, docs, sf_dir: mixed_rows(docs))),
    ("sharding", _stage(lambda spark, docs, sf_dir: shard_documents(docs))),
]

#: The network and the shingle hashes can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a table between two stages goes once the next has been read."""
    docs, last = table(spark, sf_dir, "documents"), []
    _before.clear()  # another run's tables are not ours to delete
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            delete(spark, last)
            last = [path]
    _before.clear()
    return docs
