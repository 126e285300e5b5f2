"""Shards of nearly equal size, by sampled splitters.

Records are put in the order of a key (a hash of the text, then doc_id), so that equal texts lie side
by side. Splitters come from a size-weighted sample of the keys: a record is drawn with a probability
in proportion to its bytes, and the sample's quantiles cut the key space into ranges. Ranges are then
measured over all records. A key that alone is larger than a range gets a range of its own and is
subdivided by doc_id (rows without one by their place in the input); any other overfull range is
subdivided by key, into as many parts as its rows ask for. The number of ranges is fixed, so the cuts are a
bounded list whatever the input. With the bytes and rows in front
of each range known, every record's place in the whole order is exact, and shard boundaries fall at
equal bytes of it: the law is ``bytes``. Texts of one group stay together unless they had to be
subdivided.

Column functions only. The text is read once, into (doc_id, size, CRC, key) in the shared folder. A
window is a part of a range: about RANGE_ROWS rows, or the copies of one text that is smaller than a range.
The facts of ranges with a thousandth of the rows go to their rows by a checked broadcast.

Defined results: null text has 0 bytes and the CRC of nothing; a null doc_id sorts first; rows
repeated whole take consecutive slots; empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cellweave.llm.common import join_facts, staged, table, text_or_empty

N_SHARDS = 16
#: Ranges for each shard, and rows of a part of a range.
RANGES_PER_SHARD = 32
RANGE_ROWS = 20_000
#: Expected draws for each range.
DRAWS = 32
SEED = 20_011


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the key and a number of the row."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def splitters(records: DataFrame, n_ranges: int, total: int) -> list[int]:
    """Quantiles of a size-weighted sample of the keys, and the two edges of each key larger than a range."""
    unit = F.shiftrightunsigned(F.xxhash64("key", "doc_id", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    drawn = records.where(unit < F.col("size") * F.lit(DRAWS * n_ranges / total))
    parts = [F.lit(i / n_ranges) for i in range(1, n_ranges)]
    quantiles = drawn.agg(F.percentile_approx("key", F.array(*parts), 20 * n_ranges).alias("q")).first()["q"] or []
    # Each has more than total / n_ranges bytes: fewer than n_ranges of them.
    large = records.groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") * n_ranges > total).select("key")
    edges = [e for r in large.toLocalIterator() for e in (r["key"], r["key"] + 1)]
    return sorted(set(quantiles) | {e for e in edges if e < 1 << 63})


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below the key: a binary search in one expression."""
    if not cuts:
        return F.lit(0)
    held = F.lit(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    fits = lambda at: (at <= len(cuts)) & (F.get(held, at - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def placed(records: DataFrame, n_shards: int) -> DataFrame:
    """``records`` (doc_id, size, text_crc32, key, row) with shard and slot."""
    facts = records.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).first()
    n_rows, total = facts["n"], facts["b"] or 1
    n_ranges = n_shards * RANGES_PER_SHARD
    cuts = splitters(records, n_ranges, total)
    ranged = records.withColumn("range", range_of(F.col("key"), cuts))

    # Overfull ranges: parts by key, or by doc_id where there is but one key.
    stats = ranged.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    parts = F.ceil(F.greatest(F.col("bytes") * n_ranges / total, F.col("rows") / RANGE_ROWS) / 2)
    stats = staged(stats.select("range", "low", "high", "rows", F.greatest(parts, F.lit(1)).alias("parts")), "ranges")
    span = F.col("high").cast("double") - F.col("low").cast("double") + 1
    by_key = F.floor((F.col("key").cast("double") - F.col("low").cast("double")) / span * F.col("parts"))
    unique = F.when(F.col("doc_id").isNull(), F.xxhash64("row", F.lit(SEED))).otherwise(F.xxhash64("doc_id", F.lit(SEED)))
    part = F.when(F.col("low") == F.col("high"), F.pmod(unique, "parts")).otherwise(
        F.least(F.greatest(by_key, F.lit(0)), F.col("parts") - 1)
    )
    cut = join_facts(ranged, stats, ["range"], "rows", n_rows).select("doc_id", "size", "text_crc32", "key", "range", part.alias("part"),
                                             (F.col("low") == F.col("high")).alias("one_key"))

    # What lies in front of each part: one row per part, few against the records.
    front = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    sums = sums.select(
        "range", "part", F.coalesce(F.sum("b").over(front), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(front), F.lit(0)).alias("n0")
    )
    inside = W.partitionBy("range", "part").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    of_key = W.partitionBy("range", "part", "key")
    cut = cut.join(sums, ["range", "part"])
    end = F.col("b0") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))
    cut = cut.withColumns({"end": end, "place": F.col("n0") + F.row_number().over(inside) - 1})
    # A group goes where its middle lies; the records of a subdivided group each go where theirs does.
    middle = F.when(F.col("one_key"), F.col("end") - F.col("size") / 2).otherwise((F.min(F.col("end") - F.col("size")).over(of_key) + F.max("end").over(of_key)) / 2)
    cut = cut.withColumn("shard", F.least(F.floor(middle * n_shards / total), F.lit(n_shards - 1)).cast("int"))
    starts = cut.groupBy("shard").agg(F.min("place").alias("start"))  # n_shards rows
    return cut.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("start")).cast("long").alias("slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: this law doesn't grow)."""
    return placed(staged(measured(docs), "sizes"), n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_sharding(spark, sf_dir) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
