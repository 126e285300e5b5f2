"""Near copies by SimHash fingerprints of word 4-grams, found with multi-index hashing.

1. One pass over the texts gives each row's 64-bit fingerprint; distinct fingerprints are the classes.
2. A fingerprint is cut into m segments. With RADIUS = a * m + b, fingerprints within RADIUS bits have one
   of the first b + 1 segments within a bits of each other, or one of the others within a - 1 (else they
   would differ in more bits). So each class is entered in m tables under its segments, and asks each
   table for all keys of the segment's small Hamming ball. m is chosen by the estimated rows to be sent
   and distances to be taken; it changes the cost, never the result.
3. The entries of a key and the classes that ask for it meet in a task, which takes complete distances.
   A class that is linked already leaves the rest of the search (``bucket_links``), so a crowd of near
   copies costs about its size, not its square, and gives one link per class instead of all pairs.
   Keys above ``BUCKET`` rows are dealt over tasks by pairs of blocks: all pairs meet, memory is bounded.
4. Components of the links; the least doc_id of a component goes back to its rows.

Defined results: null or empty text, or text of white space, has fingerprint zero and is linked like any
other; fewer than four words are one shingle; repeated words and shingles count each time; rows with the
same doc_id are rows of their own; a null doc_id takes part and is never the least, a component of null
ids alone has component null. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm.common import id_text, join_facts, pieces, staged, table, whole_groups
from cellweave.llm.components import components

N = 4
SEED = 42
BITS = 64
RADIUS = 4
#: Rows of one key in one task.
BUCKET = 1 << 16
#: Cost of sending a row, in distances taken.
SEND_COST = 200
#: Shingles whose bits are counted at once, and bytes of text taken at once.
CHUNK = 1 << 16
TEXT_CHUNK = 1 << 20


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z alone, and the white space 0x20, 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(len(words) - N + 1, 1)
    last = ends[min(N, len(words)) - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, CHUNK):
        cuts = zip(starts[at : min(at + CHUNK, count)].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in cuts], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", TEXT_CHUNK):
        texts = batch.column("text").cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row, the fingerprint as a signed long."""
    return id_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def segments(m: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of the m segments; the wider ones come first."""
    a, b = divmod(RADIUS, m)
    widths = [BITS // m + (k < BITS % m) for k in range(m)]
    return [(sum(widths[:k]), widths[k], a if k <= b else a - 1) for k in range(m)]


def ball_size(width: int, radius: int) -> int:
    out, term = 0, 1
    for k in range(radius + 1):
        out += term
        term = term * (width - k) // (k + 1)
    return out


def choose_segments(n: int) -> int:
    """The number of segments, 2 to 4, with the least estimated cost for n fingerprints."""

    def cost(m: int) -> float:
        return sum(ball_size(w, r) * (SEND_COST + n / 2**w) for _, w, r in segments(m))

    return min((4, 3, 2), key=cost)


def _ball(key: Column, width: int, radius: int) -> Column:
    """The keys within ``radius`` (0 to 2) bits, the key itself first."""
    flips = [0]
    if radius >= 1:
        flips += [1 << i for i in range(width)]
    if radius >= 2:
        flips += [1 << i | 1 << j for i in range(width) for j in range(i)]
    return F.transform(F.array(*map(F.lit, flips)).cast("array<bigint>"), lambda f: key.bitwiseXOR(f))


def table_rows(classes: DataFrame, m: int) -> DataFrame:
    """(segment, key, fp, entry): a row per table entry, and one per further key that a class asks for."""
    out = []
    for k, (first, width, radius) in enumerate(segments(m)):
        key = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        asked = classes.select(F.lit(k).alias("segment"), F.posexplode(_ball(key, width, radius)).alias("nth", "key"), "fp")
        out.append(asked.select("segment", "key", "fp", (F.col("nth") == 0).alias("entry")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.union(more)
    return rows


def bucket_links(fps: np.ndarray, entry: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Links (fingerprints, fingerprint) that connect all similar pairs with an entry of the table among them.

    Breadth first: whatever is within RADIUS of a visited class is linked to it and leaves the search.
    Two classes that only ask are not compared: if they are similar, a table has one of them.
    """
    entries, askers = fps[entry], fps[~entry]
    while len(entries):
        queue, entries = [(int(entries[0]), True)], entries[1:]
        while queue and len(entries) + len(askers):
            at, is_entry = queue.pop()
            near = np.bitwise_count(entries ^ np.uint64(at)) <= RADIUS
            if near.any():
                yield entries[near], at
                queue += [(x, True) for x in entries[near].tolist()]
                entries = entries[~near]
            if is_entry:
                near = np.bitwise_count(askers ^ np.uint64(at)) <= RADIUS
                if near.any():
                    yield askers[near], at
                    queue += [(x, False) for x in askers[near].tolist()]
                    askers = askers[~near]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["segment", "key", "i", "j"]
    for t, at in whole_groups(batches, keys, 50_000):
        fps, entry = t.column("fp").to_numpy().view(np.uint64), t.column("entry").to_numpy(zero_copy_only=False)
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a > 1:
                for many, one in bucket_links(fps[a:b], entry[a:b]):
                    left.append(many)
                    right.append(np.full(len(many), one, np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["u", "v"])


def links(classes: DataFrame, n: int, bucket: int = BUCKET, m: int | None = None) -> DataFrame:
    """(u, v): links that connect all pairs of the n fingerprints within RADIUS bits."""
    rows = table_rows(classes.select("fp"), m or choose_segments(n))
    # Staged, so that the list of crowded keys is broadcast only if it measures small.
    crowded = rows.groupBy("segment", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket)
    blocks = staged(crowded.select("segment", "key", F.ceil(F.col("rows") / bucket).alias("blocks")), "crowded-keys")
    dealt = rows.join(blocks, ["segment", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # A class of block b is needed for the pairs (b, k) and (k, b).
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j"))))
    placed = dealt.select("segment", "key", "fp", "entry", pair.alias("p")).select("segment", "key", "p.i", "p.j", "fp", "entry")
    keys = ["segment", "key", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links, "u long, v long")


def near_groups(docs: DataFrame, bucket: int = BUCKET, m: int | None = None) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    rows = staged(fingerprints(docs), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "fingerprint-classes")
    roots = components(links(classes, classes.count(), bucket, m)).withColumnRenamed("node", "fp")
    linked = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    facts = staged(linked.join(least, "root").select("fp", "component_id", "rows"), "fingerprint-groups")
    return join_facts(rows, facts, ["fp"], "rows", rows.count()).select("doc_id", "fp", "component_id")


def op11_simhash(spark, sf_dir) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
