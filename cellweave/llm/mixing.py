"""A mix of sources to target weights, by Sainte-Lague apportionment of equal blocks.

The sources' targets are their weights' parts of the total, at most twice a source's size; what is
above goes to the others by weight until none is above (a water level, found in one sort). The total
is a number of equal blocks: of MOST_BLOCK words, or of fewer so that the least target has LEAST_BLOCKS of
them, down to single words. Blocks go to the sources by highest quotients target / (2s + 1), and a source's
blocks to its cells (hash shards of its documents, of bounded rows) in the same way, so each cell has an
integer quota. In a cell the documents lie on one line of words, in seeded order; the line is cut into
blocks, a quota takes whole passes over all blocks and a seeded selection of the rest: block b is in it if
a multiple of blocks / rest lies in (b + shift, b + shift + 1], which selects exactly ``rest`` of them, evenly
from a seeded shift on. A document's taken words are its words in selected blocks, counted from the blocks
at its ends and the number between, so a document costs the same whatever the size of a block.

Words are counted once, into (doc_id, source, size) in the shared folder. A source with a third of all
rows is many cells; no window is larger than a cell. Per-source and per-cell tables are all that is
ever brought together, one row per source in one task.

Defined results: null text has 0 words and nothing is taken; a null source is a source of its own, the
last; rows repeated whole are counted and taken each; a null doc_id is hashed like any other value;
empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cellweave.llm.common import WORD, staged, table, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
MOST_BLOCK = 64
LEAST_BLOCKS = 100
CELL_ROWS = 4_000
SEED = 40_009


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float = CAP) -> np.ndarray:
    """Parts of the total by weight, none above cap * size; the capped are those of least size / weight."""
    limit = cap * sizes.astype(float)
    order = np.argsort(limit / weights, kind="stable")
    out, left, weight = np.zeros(len(sizes)), float(total), float(weights.sum())
    for k, i in enumerate(order):
        if limit[i] / weights[i] >= left / weight:
            rest = order[k:]
            out[rest] = left * weights[rest] / weight
            break
        out[i] = limit[i]
        left, weight = left - limit[i], weight - weights[i]
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2s + 1); equal quotients go to the earlier party."""
    got = np.zeros(len(votes), np.int64)
    if seats <= 0 or not len(votes) or votes.sum() <= 0:
        return got
    given = lambda divisor: np.floor(votes / divisor + 0.5).astype(np.int64)
    low, high = votes.sum() / (seats + len(votes) + 1) / 4, votes.sum() / seats * 4 + votes.max() * 4
    for _ in range(200):  # the least divisor that gives no more than the seats
        middle = (low + high) / 2
        low, high = (low, middle) if given(middle).sum() <= seats else (middle, high)
    got = given(high)
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, got)) if v > 0]
    heapq.heapify(heap)
    for _ in range(int(seats - got.sum())):
        _, i = heap[0]
        got[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the source as two columns without nulls, and the words."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
    )


def _quotas(sources: pd.DataFrame) -> pd.DataFrame:
    # Code points order as UTF-8 bytes do; the null source is last.
    order = sorted(range(len(sources)), key=lambda i: (sources["no_source"].iloc[i], sources["source"].iloc[i].encode()))
    out = sources.iloc[order].reset_index(drop=True)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(out))])
    sizes = out["source_size"].to_numpy(np.int64)
    out["target"] = targets(sizes, weights, SHARE * int(sizes.sum()))
    some = out["target"].to_numpy()[out["target"].to_numpy() > 0]
    out["block"] = block = max(1, min(MOST_BLOCK, int(some.min()) // LEAST_BLOCKS)) if len(some) else 1
    out["blocks"] = sainte_lague(out["target"].to_numpy(), round(out["target"].sum() / block))
    out["cells"] = np.maximum(1, -(-out["n_rows"] // CELL_ROWS))
    return out.drop(columns="all")


def source_quotas(records: DataFrame) -> DataFrame:
    """One row per source: its words, target, blocks and number of cells."""
    sums = records.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    schema = "no_source boolean, source string, source_size long, n_rows long, target double, block long, blocks long, cells long"
    return sums.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(_quotas, schema)


def _cell_quotas(cells: pd.DataFrame) -> pd.DataFrame:
    out = cells.sort_values("cell").reset_index(drop=True)
    words = out["words"].to_numpy(np.int64)
    got = sainte_lague(words.astype(float), int(out["blocks"].iloc[0]))
    lines = np.maximum(-(-words // int(out["block"].iloc[0])), 1)
    out["whole"] = np.minimum(got // lines, int(CAP))
    out["rest"], out["lines"] = np.where(out["whole"] < CAP, got - out["whole"] * lines, 0), lines
    out["shift"] = (out["cell"] * 7919 + SEED) % lines
    return out[["no_source", "source", "cell", "whole", "rest", "lines", "shift"]]


def mix(records: DataFrame) -> DataFrame:
    """``records`` as ``measured`` gives them, with source_size, target and taken."""
    by, place = ["no_source", "source"], ["no_source", "source", "cell"]
    quotas = staged(source_quotas(records), "quotas")
    seeded = F.xxhash64("doc_id", "size", F.lit(SEED))
    celled = records.join(quotas, by).withColumn("cell", F.pmod(seeded, "cells"))
    words = celled.groupBy(*place).agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("blocks").alias("blocks"))
    plans = words.groupBy(*by).applyInPandas(
        _cell_quotas, "no_source boolean, source string, cell long, whole long, rest long, lines long, shift long"
    )
    line = W.partitionBy(*place).orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id", "size")
    start = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    laid = celled.withColumn("start", start).join(plans, place)
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((end - 1) / F.col("block"))
    # Selected blocks before block b, as decimals: the product may pass 64 bits.
    before = lambda b: F.floor((b + F.col("shift")).cast("decimal(20,0)") * F.col("rest") / F.col("lines")).cast("long")
    chosen = lambda b: before(b + 1) - before(b)
    inside = lambda b: F.least((b + 1) * F.col("block"), end) - F.greatest(b * F.col("block"), F.col("start"))
    between = F.when(last > first, (before(last) - before(first + 1)) * F.col("block") + chosen(last) * inside(last)).otherwise(0)
    extra = chosen(first) * inside(first) + between
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("whole") * F.col("size") + extra)
    return laid.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(staged(measured(docs), "words"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: whole documents, 0 to 2 times.

    A document's taken words over its size is its number of copies; a fraction is rounded up or down
    by a seeded draw, in proportion. Documents without words are not taken.
    """
    share = F.col("taken") / F.col("size")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED + 2)), 11) / F.lit(float(1 << 53))
    copies = F.when(F.col("size") > 0, F.floor(share) + (draw < share - F.floor(share)).cast("int")).otherwise(0)
    plan = mix_documents(docs).select("doc_id", "size", copies.cast("int").alias("copies"))
    plan = plan.groupBy("doc_id", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), size.alias("words"))
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("words") == F.col("size")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op10_mixing(spark, sf_dir) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
