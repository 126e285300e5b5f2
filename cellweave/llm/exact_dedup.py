"""Exact dedup against a history, through minimal perfect hashing.

The distinct digests of the historical documents go into shards by hash. Each shard holds a minimal
perfect hash over its digests: level by level, digests that are alone at their bit stay there and
the rest go on to the next, smaller level; a digest's slot is the rank of its bit. The slot holds
the full digest, the locator (doc_id) of the winner and the number of rows. A lookup finds the slot of
any digest and compares all 32 bytes: equal means a repeat, which is counted at its slot and won by its
locator; anything else is no member, and a group of its own. The lookup alone decides that: the two sides
are never grouped together.

At scale: texts are hashed once, into (doc_id, digest) in the shared folder. A shard is a bounded number
of digests, built and probed in one task; both sides of a probe are distinct digests (combined on the
map side before), so a text that a third of all rows share is one row there. Group facts go back to the
rows by a join: the groups with a thousandth of all rows or more are at most a thousand and are
broadcast, all others are too small to skew it.

Defined results: null text is empty text; a null doc_id loses to any other; rows repeated whole
each come back; as nothing tells them apart, every row with the keeper's doc_id is kept. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm.common import SPACE, join_facts, mix64, staged, table, text_or_empty

#: Digests to a shard at most, in expectation.
SHARD_KEYS = 4_000
#: Bits of a level per digest that comes to it.
GAMMA = 2.0

INDEX = "shard int, n long, levels binary, digests binary, locators binary, nulls binary, counts binary"
FACTS = "text_sha256 string, keep long, no_keep boolean, group_size long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the normalised text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(text_or_empty()), 256).alias("text_sha256")
    )


def winners(keyed: DataFrame) -> DataFrame:
    """Per digest its smallest doc_id and its number of rows; combines on the map side."""
    return keyed.groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


def _words(hexes: pd.Series) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    return np.frombuffer(bytes.fromhex("".join(hexes)), ">u8").astype(np.uint64).reshape(-1, 4)


def _at(words: np.ndarray, level: int, m: int) -> np.ndarray:
    """Bit of each digest at a level of m bits; all four words count."""
    h = np.full(len(words), level + 1, np.uint64)
    for k in range(4):
        h = mix64(h ^ words[:, k])
    return (h % np.uint64(m)).astype(np.int64)


def mph_build(words: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Level bit arrays, and the slot of each of the distinct digests."""
    levels: list[np.ndarray] = []
    slots = np.empty(len(words), np.int64)
    left, base = np.arange(len(words)), 0
    while len(left):
        m = max(8, int(GAMMA * len(left)))
        at = _at(words[left], len(levels), m)
        bits = np.bincount(at, minlength=m) == 1
        alone = bits[at]
        slots[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, slots


def mph_slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 for those that fall through all levels (certainly no members)."""
    slots = np.full(len(words), -1, np.int64)
    left, base = np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = _at(words[left], level, len(bits))
        hit = bits[at]
        slots[left[hit]] = base + (np.cumsum(bits) - 1)[at[hit]]
        base += int(bits.sum())
        left = left[~hit]
    return slots


def _pack(levels: list[np.ndarray]) -> bytes:
    head = struct.pack(f"<{len(levels) + 1}q", len(levels), *map(len, levels))
    return head + b"".join(np.packbits(x).tobytes() for x in levels)


def _unpack(blob: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    sizes, at, out = struct.unpack_from(f"<{n}q", blob, 8), 8 * (n + 1), []
    for m in sizes:
        nb = (m + 7) // 8
        out.append(np.unpackbits(np.frombuffer(blob, np.uint8, nb, at), count=m).astype(bool))
        at += nb
    return out


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("text_sha256"), F.lit(n_shards)).cast("int").alias("shard")


def _id() -> list[Column]:
    """A doc_id as two columns without nulls, which pandas keeps exact."""
    return [F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id")]


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    words = _words(rows["text_sha256"])
    levels, slots = mph_build(words)
    digest = np.empty((len(words), 4), ">u8")
    digest[slots] = words
    locator, null, counts = np.zeros(len(words), "<i8"), np.zeros(len(words), bool), np.zeros(len(words), "<i8")
    locator[slots] = rows["id"]
    null[slots] = rows["no_id"]
    counts[slots] = rows["n"]
    return pd.DataFrame(
        {"shard": [rows["shard"].iloc[0]], "n": [len(words)], "levels": [_pack(levels)], "digests": [digest.tobytes()],
         "locators": [locator.tobytes()], "nulls": [np.packbits(null).tobytes()], "counts": [counts.tobytes()]}
    )


def shard_count(n_rows: int) -> int:
    return max(1, -(-n_rows // SHARD_KEYS))


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard. ``history``: distinct digests with the winner's doc_id and the number of rows."""
    keyed = history.select(_shard(n_shards), "text_sha256", *_id(), "n")
    return keyed.groupBy("shard").applyInPandas(_build_shard, INDEX)


def member_slots(index: pd.Series, words: np.ndarray) -> np.ndarray:
    """The slot of each digest that the shard holds, compared byte by byte; -1 for all others."""
    slots = mph_slots(_unpack(index["levels"]), words)
    held = np.frombuffer(index["digests"], ">u8").reshape(-1, 4)
    found = slots >= 0
    found[found] = (held[slots[found]] == words[found]).all(axis=1)
    return np.where(found, slots, -1)


def _probe(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Facts of a shard: one row per slot, with the repeats counted there, and one per nonmember."""
    fresh = rows.rename(columns={"id": "keep", "no_id": "no_keep", "n": "group_size"})[["text_sha256", "keep", "no_keep", "group_size"]]
    if not len(index):
        return fresh
    shard = index.iloc[0]
    counts = np.frombuffer(shard["counts"], "<i8").copy()
    if len(rows):
        slots = member_slots(shard, _words(rows["text_sha256"]))
        member = slots >= 0
        counts[slots[member]] += rows["n"].to_numpy()[member]
        fresh = fresh[~member]
    digest = shard["digests"].hex()
    known = pd.DataFrame(
        {"text_sha256": [digest[64 * k : 64 * k + 64] for k in range(len(counts))], "keep": np.frombuffer(shard["locators"], "<i8"),
         "no_keep": np.unpackbits(np.frombuffer(shard["nulls"], np.uint8), count=len(counts)).astype(bool), "group_size": counts}
    )
    return pd.concat([known, fresh], ignore_index=True) if len(fresh) else known


def dedup(history: DataFrame, incoming: DataFrame, n_rows: int) -> DataFrame:
    """Facts of every digest of either side: text_sha256, keep_id, group_size.

    Both inputs have doc_id and text_sha256, together ``n_rows`` rows; a digest of the history is won
    there, whatever the ids of the incoming rows.
    """
    n_shards = shard_count(n_rows)
    index = build_index(winners(history), n_shards)
    left = winners(incoming).select(_shard(n_shards), "text_sha256", *_id(), "n").groupBy("shard")
    facts = left.cogroup(index.groupBy("shard")).applyInPandas(_probe, FACTS)
    return facts.select("text_sha256", F.when(~F.col("no_keep"), F.col("keep")).alias("keep_id"), "group_size")


def op1_exact_dedup(spark, sf_dir) -> DataFrame:
    """History: the lower half of the doc_id range. It holds the smaller ids, so its winners stay."""
    keyed = staged(digests(table(spark, sf_dir, "documents")), "digests")
    n_rows, low, high = keyed.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    middle = (low + high) // 2 if low is not None else 0
    old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    facts = staged(dedup(keyed.where(old), keyed.where(~old), n_rows), "digest-groups")
    return join_facts(keyed, facts, ["text_sha256"], "group_size", n_rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


SQL = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
