"""Removal of repeated passages: bytes covered by a 100-byte string that also starts earlier.

Suffixes are compared to a depth of LENGTH bytes, in blocks, with a difference cover for long ties
(difference_cover.py). A suffix's block is chosen by content, so that equal windows always meet:

1. anchors: of the hashes of all GRAM-byte strings in a window, the least (leftmost) marks the window's
   anchor. Neighbouring windows share it; together they are the anchor's context of 168 bytes at most.
   Equal windows have equal anchors at equal places. About one place in 35 is an anchor;
2. equal contexts (128 bits of hash) are repeats as a whole: all but the first are removed, inside a
   task's batch at once, so that a text in very many copies reaches the shuffle once per batch. Anchors
   without a second context end here. That is one shuffle of (hash, hash, document, place);
3. what is left are contexts that share their middle but not all: their bytes are fetched, dealt by
   anchor, and their suffixes sorted bucket by bucket; of equal windows the first stays;
4. an anchor with more than HOT contexts would not fit a task: its windows are grouped as they are, by
   their 100 bytes, combined on the map side;
5. ranges of removed bytes per document meet its text; it is cut and hashed.

The texts are shuffled once by document for 3 and 5. Long texts are read in segments with an overlap.

Defined results: null text is empty (0 bytes, nothing removed, the hash of nothing); texts below 100
bytes keep everything; rows with the same doc_id and text count as the same document, none earlier than
the other; a null doc_id is later than all others. Empty input gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cellweave.llm.common import mix64, pieces, powers, staged, table, text_or_empty, utf8, whole_groups
from cellweave.llm.difference_cover import equal_windows

LENGTH = 100
GRAM = 32
CHUNK = 1 << 20
SEGMENT = 1 << 20
#: Text whose anchors are collapsed together before the shuffle.
COLLAPSE = 16 << 20
BLOCK_CONTEXTS = 10_000
HOT = 50_000
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MAX = np.uint64((1 << 64) - 1)
#: A place and its range in one long: start, windows - 1, anchor - start.
_START, _COUNT, _ANCHOR = 30, 23, 16


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = pick(x[:-have], x[have:]), 2 * have
    more = width - have
    return pick(x[: len(x) - more], x[more:]) if more else x


def anchors(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of a batch: text number, start in it, windows - 1, anchor - start, two hashes."""
    n, width = len(data), LENGTH - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, empty, empty
    byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[data]
    base = powers(_BASE, GRAM + 1)
    h, have = byte, 1
    while have < GRAM:
        h, have = h[:-have] * base[have] + h[have:], 2 * have
    h = mix64(h) >> np.uint64(1)  # the largest number is left for strings across two texts
    valid = np.ones(n - LENGTH + 1, bool)
    for s, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
        h[max(e - GRAM + 1, s, 0) : e] = _MAX
        valid[max(e - LENGTH + 1, s) : e] = False
    least = _sliding(h, width, np.minimum)[: len(valid)]
    windows = np.flatnonzero(valid)
    if not len(windows):
        return empty, empty, empty, empty, empty, empty
    held = np.where(valid, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    some = h == _sliding(np.concatenate([pad, held, pad]), width, np.maximum)[: len(h)]
    places = np.flatnonzero(some)
    nth = (np.cumsum(some) - some)[windows]  # the first chosen place at or after the window's start
    wrong = np.flatnonzero(h[places[nth]] != least[windows])
    while len(wrong):
        nth[wrong] += 1
        wrong = wrong[h[places[nth[wrong]]] != least[windows[wrong]]]
    anchor = places[nth]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(windows)]]) - 1
    start, count, anchor = windows[first], last - first, anchor[first]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * powers(_BASE, n), dtype=np.uint64)])
    whole = (sums[start + count + LENGTH] - sums[start]) * powers(_INVERSE, n)[start]
    whole = mix64(whole + (count * 128 + anchor - start).astype(np.uint64))
    text = np.searchsorted(offs, start, "right") - 1
    return text, start - offs[text], count, anchor - start, h[anchor].view(np.int64), whole.view(np.int64)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors, and (with a negative place) contexts that are repeats inside this batch."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        doc, check, place, one, two = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, two, one))
        doc, check, place, one, two = doc[order], check[order], place[order], one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        at = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first row of each context
        later = (doc > doc[at]) | ((doc == doc[at]) & (place >> _START > place[at] >> _START))
        one = np.where(later, mix64((doc ^ place).view(np.uint64)).view(np.int64), one)
        place = np.where(later, -place - 1, place)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, doc, check, place)], ["anchor", "context", "doc", "check", "place"])

    for batch in pieces(batches, "text", CHUNK):
        offs, data = utf8(batch.column("text"))
        doc, check = batch.column("doc").to_numpy(), batch.column("check").to_numpy()
        for s in range(0, max(len(data), 1), SEGMENT) if len(offs) == 2 else [0]:
            if len(offs) == 2:
                part = data[s : s + SEGMENT + LENGTH - 1]
                found = anchors(np.array([0, len(part)]), part)
            else:
                found = anchors(offs, data)
            text, start, count, back, one, two = found
            held.append((doc[text], check[text], ((start + s) << _START) | (count << _COUNT) | (back << _ANCHOR), one, two))
        size += len(data)
        if size >= COLLAPSE:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each document."""
    for batch in batches:
        for k in range(batch.num_rows):
            raw = (batch.column("text")[k].as_py() or "").encode()
            wanted = batch.column("wanted").slice(k, 1).flatten()
            one, place = wanted.field("anchor"), wanted.field("place")
            at = place.to_numpy()
            start, count = at >> _START, (at >> _COUNT) & 127
            pieces_ = [raw[s : s + c + LENGTH] for s, c in zip(start.tolist(), count.tolist())]
            doc, check = (pa.array(np.full(len(at), batch.column(c)[k].as_py(), np.int64)) for c in ("doc", "check"))
            yield pa.RecordBatch.from_arrays([one, doc, check, place, pa.array(pieces_, pa.binary())], ["anchor", "doc", "check", "place", "bytes"])


def _ranges(doc: np.ndarray, start: np.ndarray, check: np.ndarray) -> list[pa.Array]:
    """Windows, in order of document and start, as ranges of bytes."""
    if not len(doc):
        return [pa.array([], pa.int64())] * 4
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (check[1:] != check[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(doc)]]) - 1
    return [pa.array(x) for x in (doc[first], check[first], start[first], start[last] + LENGTH)]


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of the contexts of some anchors at a time; windows that start earlier elsewhere go."""
    for t, _ in whole_groups(batches, ["anchor"], BLOCK_CONTEXTS):
        offs, data = utf8(t.column("bytes"))
        doc, place = t.column("doc").to_numpy(), t.column("place").to_numpy()
        count = ((place >> _COUNT) & 127) + 1
        row = np.repeat(np.arange(len(place)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        label = equal_windows(data, offs[row] + step, LENGTH)
        whose, start, check = doc[row], (place[row] >> _START) + step, t.column("check").to_numpy()[row]
        order = np.lexsort((start, whose, label))
        new = np.ones(len(order), bool)
        new[1:] = label[order[1:]] != label[order[:-1]]
        at = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = order[(whose[order] > whose[at]) | (start[order] > start[at])]
        later = later[np.lexsort((start[later], check[later], whose[later]))]
        yield pa.RecordBatch.from_arrays(_ranges(whose[later], start[later], check[later]), ["doc", "check", "s", "e"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the ranges of each document, remove them, hash the rest."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for k in range(batch.num_rows):
            raw = (batch.column("text")[k].as_py() or "").encode()
            ranges = batch.column("ranges").slice(k, 1).flatten()
            spans = 0
            kept = raw
            if len(ranges):
                s, e = ranges.field("s").to_numpy(), ranges.field("e").to_numpy()
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                start, end = s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]
                spans = len(start)
                kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
            out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
        columns = [pa.array([o[k] for o in out], pa.string() if k == 3 else pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def _place(name: str, shift: int, bits: int = 7):
    return F.shiftright(F.col(name), shift).bitwiseAND(F.lit((1 << bits) - 1))


def repeated_ranges(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, check, s, e): ranges of bytes that start earlier elsewhere. ``texts``: doc_id, doc, check, text."""
    found = texts.select("doc", "check", "text").mapInArrow(_anchor_rows, "anchor long, context long, doc long, check long, place long")
    own = W.partitionBy("anchor", "context").orderBy("doc", "place")
    of_anchor = W.partitionBy("anchor")
    start = F.shiftright("place", _START)
    seen = found.select(
        "*", F.first("doc").over(own).alias("doc0"), F.shiftright(F.first("place").over(own), _START).alias("start0"),
        (F.min("context").over(of_anchor) != F.max("context").over(of_anchor)).alias("several"),
    )
    later = (F.col("place") < 0) | (F.col("doc") > F.col("doc0")) | ((F.col("doc") == F.col("doc0")) & (start > F.col("start0")))
    place = F.when(F.col("place") < 0, -F.col("place") - 1).otherwise(F.col("place")).alias("place")
    marks = staged(seen.where(later | F.col("several")).select("anchor", "doc", "check", place, later.alias("later")), "anchors")

    s = F.shiftright("place", _START)
    whole = marks.where("later").select("doc", "check", s.alias("s"), (s + _place("place", _COUNT) + LENGTH).alias("e"))

    open_ = marks.where("NOT later")
    crowded = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"))
    open_ = open_.join(crowded, "anchor", "left")

    def contexts(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy("doc", "check").agg(F.collect_set(F.struct("anchor", "place")).alias("wanted"))
        return texts.join(wanted, ["doc", "check"]).mapInArrow(_slice, "anchor long, doc long, check long, place long, bytes binary")

    few = contexts(open_.where("hot IS NULL")).repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = few.mapInArrow(_sort_blocks, "doc long, check long, s long, e long")

    # Crowded anchors: each window by its own bytes.
    many = contexts(open_.where("hot")).select("doc", "check", "place", "bytes", F.explode(F.sequence(F.lit(0), _place("place", _COUNT).cast("int"))).alias("k"))
    many = many.select("doc", "check", (F.shiftright("place", _START) + F.col("k")).alias("s"), F.expr(f"substring(bytes, k + 1, {LENGTH})").alias("w"))
    first = many.groupBy("w").agg(F.min(F.struct("doc", "s")).alias("first"))
    crowd = many.join(first, "w").where("struct(doc, s) > first").select("doc", "check", "s", (F.col("s") + LENGTH).alias("e"))
    return whole.unionByName(sorted_).unionByName(crowd)


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    text = text_or_empty()
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("check"), text.alias("text")
    )
    ranges = repeated_ranges(texts, hot).groupBy("doc", "check").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    return texts.join(ranges, ["doc", "check"], "left").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def op5_suffix_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
