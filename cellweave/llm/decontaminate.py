"""Benchmark passages inside documents, with edits, by q-gram counts in diagonal bands.

A document holds an item if some substring of it is within ``budget(m)`` edits of the whole item of
length m (both lower-cased, white space as one space). By the q-gram lemma such a substring shares at
least m - q + 1 - q * budget q-grams with the item, and they lie on diagonals (place in the document
minus place in the item) that differ by the budget at most. q is the largest up to Q for which that
number is positive (``gram_length``), so items of every length are found. So:

* count: the document's q-grams are looked up among the items' of that q; each hit counts for its item
  in the two overlapping bands of diagonals it lies in. A band is two budgets wide and starts at every
  budget, so that each match lies in one band whole;
* retain: bands with as many hits as the bound asks for;
* verify: an exact search, then a banded alignment of the item with the band's stretch of text.

Nothing within the budget is lost, and all that is reported is verified. Texts are read once, whole.
The items go to the tasks in blocks of BLOCK_CHARS characters, one pass over the documents each, so
what a task holds is bounded whatever the size of the benchmark. No shuffle.

Defined results: null or empty texts hold nothing; null items, and items of white space alone, are
never found; an item too short for an edit (below 1 / RATE characters) is found where it is written in
full; equal items are each found; repeated rows each give their rows; a null doc_id stays null. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellweave.llm.common import id_text, mix64, pieces, powers, table

Q = 10
#: Edits allowed per character of the item.
RATE = 0.08
BLOCK_CHARS = 4 << 20
CHUNK = 1 << 20
HITS = 1 << 21
SCHEMA = "doc_id long, item_id long, edits long, end_char long"
_BASE = 0x9E3779B97F4A7C15
_BITS = 20


def normal(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def budget(m: int) -> int:
    return int(RATE * m)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_length(m: int) -> int:
    """The largest q up to Q such that a match of an item of length m shares a q-gram: m - q + 1 > q * budget."""
    return min(Q, m // (budget(m) + 1))


def qgrams(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each place on."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    base, h, have, done = powers(_BASE, q + 1), mix64(code), 1, None
    at, left = 0, q
    while left:
        if left & 1:
            done, at = (h if done is None else done[: len(h) - at] * base[have] + h[at:][: len(h) - at]), at + have
        left >>= 1
        if left:
            h, have = h[:-have] * base[have] + h[have:], 2 * have
    return done[: len(code) - q + 1]


def aligned(item: np.ndarray, text: np.ndarray, start: int, width: int, most: int) -> tuple[int, int] | None:
    """Least edits of the item against a substring of ``text``, on diagonals start .. start + width - 1, and its end."""
    lead = max(0, -start)
    need = start + len(item) + width
    own = np.concatenate([np.zeros(lead, np.uint32), text[max(start, 0) : max(need, 0)], np.zeros(max(0, need - max(len(text), 0)), np.uint32)])
    ramp = np.arange(width)
    prev = np.zeros(width, np.int64)
    for r, c in enumerate(item):
        cur = prev + (own[r : r + width] != c)
        cur[:-1] = np.minimum(cur[:-1], prev[1:] + 1)
        prev = np.minimum.accumulate(cur - ramp) + ramp
        if prev.min() > most:
            return None
    d = int(prev.argmin())
    return int(prev[d]), start + len(item) + d


class GramIndex:
    """The q-grams of the items of one q."""

    def __init__(self, q: int, numbers: np.ndarray, code: list[np.ndarray]) -> None:
        self.q = q
        grams = [qgrams(code[i], q) for i in numbers]
        count = [len(g) for g in grams]
        gram = np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.item = np.repeat(numbers, count)[order]
        self.place = np.concatenate([np.arange(n) for n in count])[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.gram >> np.uint64(64 - _BITS)] = True


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.codes = [codes(t) for t in self.texts]
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([budget(n) for n in lengths], np.int64)
        self.step = np.maximum(self.edits, 1)
        q = np.array([gram_length(n) for n in lengths], np.int64)
        self.least = lengths - q + 1 - q * self.edits
        self.indexes = [GramIndex(int(k), np.flatnonzero(q == k), self.codes) for k in np.unique(q)]
        self.gap = int(self.edits.max()) + 1

    def bands(self, code: np.ndarray) -> list[tuple[int, int]]:
        return [found for index in self.indexes for found in self._bands(index, code)]

    def _bands(self, index: GramIndex, code: np.ndarray) -> list[tuple[int, int]]:
        """(item, band) with enough q-grams; band b covers the diagonals from b * step on, two steps wide."""
        grams = qgrams(code, index.q)
        at = np.flatnonzero(index.maybe[grams >> np.uint64(64 - _BITS)])
        low, high = np.searchsorted(index.gram, grams[at], "left"), np.searchsorted(index.gram, grams[at], "right")
        hit = high > low
        at, low, count = at[hit], low[hit], (high - low)[hit]
        found: dict[int, int] = {}
        shift = len(code) + 2 * max(map(len, self.codes)) + 4
        ends = np.cumsum(count)
        start = 0
        while start < len(at):  # so many hits at a time, whatever repeats there are
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + HITS, "right")))
            n = count[start:end]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:end], n)
            item = index.item[entry]
            band = (np.repeat(at[start:end], n) - index.place[entry]) // self.step[item]
            keys, times = np.unique(np.concatenate([item * (2 * shift) + band + shift, item * (2 * shift) + band - 1 + shift]), return_counts=True)
            if start == 0 and end == len(at):
                enough = times >= self.least[keys // (2 * shift)]
                return [(int(k // (2 * shift)), int(k % (2 * shift) - shift)) for k in keys[enough]]
            for k, t in zip(keys.tolist(), times.tolist()):
                found[k] = found.get(k, 0) + t
            start = end
        return [(k // (2 * shift), k % (2 * shift) - shift) for k, t in found.items() if t >= self.least[k // (2 * shift)]]

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text number, item number, edits, end) of the best match of each pair."""
        starts, at = [], 0
        for t in texts:
            starts.append(at)
            at += len(t) + self.gap
        # Texts are further apart than any budget: no match spans two.
        whole = ("\0" * self.gap).join(texts) + "\0" * self.gap
        code, starts = codes(whole), np.array(starts, np.int64)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, band in self.bands(code):
            m, e, step = len(self.codes[item]), int(self.edits[item]), int(self.step[item])
            first, width = band * step - e, 2 * step + 2 * e + 1
            low, high = max(first, 0), min(max(first + m + width + e, 0), len(whole))
            exact = whole.find(self.texts[item], low, high)
            if exact >= 0:
                got = (0, exact + m)
            else:
                middle = min(max(band * step + step + m // 2, 0), len(whole) - 1)
                number = int(np.searchsorted(starts, middle, "right")) - 1
                if best.get((number, item), (e + 1, 0))[0] == 0:
                    continue
                got = aligned(self.codes[item], code, first, width, e)
                if got is None or got[0] > e:
                    continue
            number = int(np.searchsorted(starts, got[1] - 1, "right")) - 1
            key = (number, item)
            got = (got[0], got[1] - int(starts[number]))
            if key not in best or got < best[key]:
                best[key] = got
        return [(n, i, *got) for (n, i), got in sorted(best.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items that have text, in blocks of bounded text."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    for r in rows.toLocalIterator():
        text = normal(r["text"])
        if text:
            block.append((r["item_id"], text))
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block
                block, size = [], 0
    if block:
        yield block


def _search(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in pieces(batches, "text", CHUNK):
            found = matcher.find([normal(t) for t in batch.column("text").to_pylist()])
            ids = batch.column("doc_id").to_pylist()
            columns = [
                pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([matcher.ids[f[1]] for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "end_char"])

    return docs.mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, edits, end_char (in the normalised text)."""
    rows = id_text(docs)
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for k, block in enumerate(item_blocks(benchmark)):
        found = _search(rows, block)
        out = found if k == 0 else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; one pass for each block of items."""
    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(_clean(block), docs.schema)
    return docs


def _clean(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in pieces(batches, "text", CHUNK):
            clean = np.ones(batch.num_rows, bool)
            clean[[f[0] for f in matcher.find([normal(t) for t in batch.column("text").to_pylist()])]] = False
            yield batch.filter(pa.array(clean))

    return run


def op4_decontaminate(spark, sf_dir) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
