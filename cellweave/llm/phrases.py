"""Collocations: frequent phrases of 2 to 4 words, mined by an FM-index per shard.

1. The texts are cut into shards of one language: up to ``SHARD`` words as numbers of the shard's own
   vocabulary, with a separator between the pieces that phrases do not cross.
2. A shard's words are indexed forwards and backwards (``FMIndex``, suffixes sorted to ``DEPTH`` words).
   An n-gram is an interval of each index. Extending it by a word to the left takes one step in the
   forward index and narrows the other interval by what sorts before the word; to the right likewise with
   the indexes exchanged. So all n-grams of a shard are enumerated with their counts, without a table
   of n-grams; ``BLOCK`` places of intervals are extended at once.
3. Counts are summed across shards. A phrase is frequent only if its parts are, so two rounds send counts
   under 64-bit hashes, and tell each shard which of its n-grams may reach ``LEAST`` in all: words and
   bigrams first, then 3- and 4-grams whose bigrams are among these. A hash that two n-grams share only
   keeps too much. Hashes are dealt over parts whose number grows with the words, so a part is bounded
   (a frequent n-gram is one number per shard).
4. The last round writes out the n-grams that are left as text, lists per shard, length and part; the sums
   of a part over these texts are exact, and the scores, extensions and ranks are joins and aggregates over
   them. All of it is integer arithmetic.

A task holds one shard or one part at a time, however many it gets: rows come in batches of ``BATCH`` bytes, what is
found leaves when ``GATHER`` n-grams have come together, and the texts of a part are summed as they come.

Defined results: null and empty texts have no words; the null language is ``und``, together with one of
that name; text of separators alone gives nothing; repeated rows count each time; a piece of any length
stays whole (a shard ends at a piece's end). Equal scores rank by count, then by phrase in UTF-8 byte
order. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cellweave.llm.common import mix64, pieces, staged, table, text_or_empty, utf8

DEPTH = 4
LEAST = 30
TOP = 2000
#: An extension with this percentage of a phrase's count takes its place.
COVER = 80
SCALE = 2_000_000
#: Words of a shard, and n-grams whose counts meet in one task.
SHARD = 1 << 21
PART = 1 << 22
#: A phrase's rank is first taken among so many portions of its language.
PORTIONS = 64
#: Bytes of text that are cut into words at once.
TEXT = 1 << 22
#: Places in an index that are extended at once, and n-grams that are sent on together.
BLOCK = 1 << 18
GATHER = 1 << 20
#: N-grams of a row, and bytes of a shard's words in a row.
ROW = 1 << 13
PIECE = 1 << 17
#: Bytes of a batch between Spark and Python, besides its last row.
BATCH = 1 << 20
#: Row groups of what is staged are some MB, since they are written and read in memory.
GROUPS = {"parquet.block.size": 1 << 24, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

_MARK = 255  # never a byte of UTF-8
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[9] = 32
_BYTES[list(b".,;:!?\n\x0b\x0c\r")] = _MARK
_TABLE = _BYTES.tobytes()
SHARDS = "lang string, seq long, piece int, words long, vocabulary binary, ids binary"


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside sends rows to Python in batches of ``BATCH`` bytes, and its shuffle files go with its end."""
    ours = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": True}
    before = {name: spark.conf.get(name, None) for name in ours}
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Per value of the key, by which the batches come sorted, its slices of them, one at a time."""

    def slices() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            v = batch.column(key).to_numpy()
            ends = np.flatnonzero(np.append(v[1:] != v[:-1], len(v) > 0)) + 1
            for a, b in zip([0, *ends.tolist()], ends.tolist()):
                yield int(v[a]), batch.slice(a, b - a)

    for value, found in itertools.groupby(slices(), lambda x: x[0]):
        yield value, (x[1] for x in found)


def _blobs(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """The data cut at the ends, as binary values."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _in_batches(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    step = max(1, rows.num_rows * BATCH // max(rows.nbytes, 1))
    for a in range(0, rows.num_rows, step):
        yield rows.slice(a, step)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of the words and marks of the texts, each text closed by a mark."""
    mark = bytes([_MARK])
    raw = b" " + mark.join([*texts, b""])
    raw = np.frombuffer(raw.translate(_TABLE).replace(mark, b" " + mark + b" "), np.uint8)
    inside = raw != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return (edges[1::2] - edges[::2]).astype(np.int32), raw[inside]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin = np.ones(1, np.int32), np.full(1, _MARK, np.uint8)
    open_: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[str, int] = {}
    seq = itertools.count()

    def closed(lang: str) -> Iterator[pa.RecordBatch]:
        lengths, data = map(np.concatenate, zip(*open_.pop(lang)))
        del held[lang]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        numbers = words.dictionary_encode()  # in the order of first use, so the mark is 0
        ids = numbers.indices.to_numpy().astype(np.int32)
        vocabulary, number, step = b"\n".join(numbers.dictionary.to_pylist()[1:]), next(seq), PIECE // 4
        for k in range(max(-(-len(ids) // step), -(-len(vocabulary) // PIECE))):
            own = ids[k * step : (k + 1) * step]
            columns = [[lang], [number], [k], [int(np.count_nonzero(own))], [vocabulary[k * PIECE : (k + 1) * PIECE]], [own.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "seq", "piece", "words", "vocabulary", "ids"])

    for batch in pieces(batches, "text", TEXT):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            lengths, data = _tokens(own)
            ends = np.cumsum(lengths, dtype=np.int64)
            marks = np.flatnonzero(data[ends - 1] == _MARK)
            at = byte = 0
            while at < len(lengths):
                parts = open_.setdefault(lang, [begin])
                room = max(SHARD - held.setdefault(lang, 1), 1)
                end = len(lengths)
                if end - at > room:  # cut at the next mark; the last one ends the texts
                    end = int(marks[np.searchsorted(marks, at + room - 1)]) + 1
                parts.append((lengths[at:end], data[byte : ends[end - 1]]))
                held[lang] += end - at
                at, byte = end, int(ends[end - 1])
                if held[lang] >= SHARD:
                    yield from closed(lang)
        while sum(held.values()) >= 2 * SHARD:  # of many languages
            yield from closed(max(held, key=held.__getitem__))
    for lang in list(open_):
        yield from closed(lang)


def shards(docs: DataFrame) -> DataFrame:
    """(shard, piece, lang, words, vocabulary, ids): a shard's rows in the order of their pieces."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    number = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("seq")
    with _small_batches(docs.sparkSession):
        return staged(texts.mapInArrow(_shards, SHARDS).withColumn("shard", number).drop("seq"), "word-shards", **GROUPS)


def _ordered(code: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of codes below ``kinds``, and the codes in it; one sort of codes with their places, where both fit 64 bits."""
    bits = len(code).bit_length()
    if int(kinds).bit_length() + bits > 64:
        order = np.argsort(code)
        return order, code[order]
    both = code.astype(np.uint64)
    del code
    both <<= np.uint64(bits)
    for a in range(0, len(both), BLOCK):
        both[a : a + BLOCK] |= np.arange(a, min(a + BLOCK, len(both)), dtype=np.uint64)
    both.sort()
    order = both & np.uint64((1 << bits) - 1)
    both >>= np.uint64(bits)
    return order.view(np.int64), both.view(np.int64)


class FMIndex:
    """The sorted suffixes of an array of numbers that begins and ends with 0, and the transform's way from last to first.

    Suffixes that agree to ``depth`` symbols stand in any order, so intervals are those of up to ``depth`` symbols.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int) -> None:
        size = len(text)
        rank, length, kinds = text.astype(np.int64), 1, symbols

        def pairs() -> np.ndarray:
            out = rank * (kinds + 1)
            out[:-length] += rank[length:]
            return out

        while length < depth:  # ranks of twice the length
            order, code = _ordered(pairs(), kinds * (kinds + 1))
            length *= 2
            if length < depth:
                code = np.cumsum(np.concatenate([[False], code[1:] != code[:-1]]))
                rank[order] = code
                kinds = int(code[-1]) + 1
        del rank, code
        counts = np.bincount(text, minlength=symbols)
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        #: The symbol that each suffix begins with.
        self.first = np.repeat(np.arange(symbols, dtype=np.int32), counts)
        #: Where the suffix stands that is longer by one symbol to the left.
        place = np.empty(size, np.int32)
        place[order] = np.arange(size, dtype=np.int32)
        order -= 1
        self.before = place[order]  # text[-1] is 0, as is text[0]
        self.bits = size.bit_length()

    def extend(self, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """All one-symbol extensions of intervals [low, high), whose intervals in the other index begin at ``other``.

        Gives (interval extended, symbol, count, low, low in the other index).
        """
        sizes = high - low
        begins = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(low)), sizes)
        code = (owner << self.bits) | self.before[np.arange(len(owner)) + np.repeat(low - begins, sizes)]
        code.sort()
        of, at = code >> self.bits, code & ((1 << self.bits) - 1)
        symbol = self.first[at]
        first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])])) if len(code) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([first, [len(code)]]))
        of, symbol, at = of[first], symbol[first], at[first]
        smaller = first - begins[of]
        real = symbol > 0
        of, symbol, count, at, smaller = of[real], symbol[real], count[real], at[real], smaller[real]
        return of, symbol, *(x.astype(np.int32) for x in (count, at, other[of] + smaller))


class Grams:
    """N-grams of one length in a shard: words (a row each), counts, and intervals of both indexes."""

    def __init__(self, words: np.ndarray, count: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> None:
        self.words, self.count, self.ahead, self.back = words, count, ahead, back

    def where(self, keep: np.ndarray) -> Grams:
        return Grams(self.words[keep], self.count[keep], self.ahead[keep], self.back[keep])

    def blocks(self) -> Iterator[Grams]:
        """In their order, cut where the intervals have BLOCK places; a longer one is alone."""
        ends = np.cumsum(self.count, dtype=np.int64)
        at = 0
        while at < len(ends):
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right"))
            yield self.where(slice(at, max(end, at + 1)))
            at = max(end, at + 1)

    @staticmethod
    def joined(parts: list[Grams], length: int) -> Grams:
        empty = np.zeros(0, np.int32)
        of = [Grams(np.zeros((0, length), np.int32), empty, empty, empty), *parts]
        return Grams(*(np.concatenate([getattr(g, name) for g in of]) for name in ("words", "count", "ahead", "back")))


class Shard:
    def __init__(self, lang: str, vocabulary: bytes, ids: bytes, depth: int) -> None:
        self.lang = lang
        raw = np.frombuffer(vocabulary, np.uint8)
        word = raw != 10
        ends = np.append(np.flatnonzero(~word), len(raw))
        self.vocabulary = _blobs(np.concatenate([[0], ends - np.arange(len(ends))]), raw[word])  # the mark is an empty word
        text = np.frombuffer(ids, np.int32)
        symbols = len(self.vocabulary)
        self.forward = FMIndex(text, symbols, depth)
        self.backward = FMIndex(text[::-1], symbols, depth) if depth > 2 else None
        seed = xxhash.xxh64_intdigest(lang.encode())
        words = (w for a in range(0, symbols, BLOCK) for w in self.vocabulary.slice(a, BLOCK).to_pylist())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, symbols)

    def unigrams(self) -> Grams:
        word, starts = np.arange(1, len(self.vocabulary), dtype=np.int32), self.forward.starts
        return Grams(word[:, None], np.diff(starts)[1:], starts[1:-1], starts[1:-1])

    def left(self, g: Grams) -> Grams:
        of, word, count, ahead, back = self.forward.extend(g.ahead, g.ahead + g.count, g.back)
        return Grams(np.column_stack([word, g.words[of]]), count, ahead, back)

    def right(self, g: Grams) -> Grams:
        of, word, count, back, ahead = self.backward.extend(g.back, g.back + g.count, g.ahead)
        return Grams(np.column_stack([g.words[of], word]), count, ahead, back)

    def longer(self, two: Grams) -> Iterator[Grams]:
        """The 3- and 4-grams all of whose bigrams are among the given ones: those of a block of these, in turns."""

        def inside(low: np.ndarray) -> np.ndarray:
            """Whether each place of an index is in a bigram's interval: these do not meet."""
            change = np.zeros(len(self.forward.first) + 1, np.int8)
            change[low] += 1
            change[low + two.count] -= 1
            return np.cumsum(change, dtype=np.int8).astype(bool)

        last, first = inside(two.back), inside(two.ahead)
        for block in two.blocks():
            three = self.right(block)
            three = three.where(last[three.back])  # its last bigram
            yield three
            for g in three.blocks():
                four = self.left(g)
                yield four.where(first[four.ahead])  # its first bigram

    def keys(self, g: Grams) -> np.ndarray:
        out = np.full(len(g.count), g.words.shape[1], np.uint64)
        for k in range(g.words.shape[1]):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[g.words[:, k]])
        return out

    def texts(self, g: Grams) -> pa.StringArray:
        words = [self.vocabulary.take(pa.array(g.words[:, k])) for k in range(g.words.shape[1])]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())).cast(pa.string())

    def phrases(self, g: Grams) -> list[str]:
        return self.texts(g).to_pylist()


def _kept(shard: Shard, g: Grams, keys: np.ndarray) -> Grams:
    """The n-grams whose key is among the sorted ones."""
    own = shard.keys(g)
    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
    return g.where(keys[at] == own if len(keys) else np.zeros(len(own), bool))


def _bigrams(shard: Shard, keys: np.ndarray) -> Grams:
    """The bigrams whose key, and whose words' keys, are among the sorted ones."""
    one = _kept(shard, shard.unigrams(), keys)
    known = np.zeros(len(shard.vocabulary), bool)
    known[one.words[:, 0]] = True
    pairs = (shard.left(g) for g in one.blocks())
    return Grams.joined([_kept(shard, two.where(known[two.words[:, 0]]), keys) for two in pairs], 2)


def _ranges(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys by part, the part that each one in order belongs to, and where rows begin: ROW keys of a part at most, which is a range of the keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    part = part[order]
    ends = np.flatnonzero(np.append(part[1:] != part[:-1], len(part) > 0)) + 1
    first = [np.arange(a, b, ROW) for a, b in zip([0, *ends.tolist()], ends.tolist())]
    return order, part, np.concatenate([np.zeros(0, np.int64), *first])


def _dealt(shard: int, grams: Iterable[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Keys and counts of n-grams as a row per part, or more of them where they come in several lots."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def lot() -> Iterator[pa.RecordBatch]:
        keys, counts = map(np.concatenate, zip(*held))
        held.clear()
        order, part, first = _ranges(keys, parts)
        ends = np.append(first[1:], len(part))
        columns = [pa.array(part[first]), pa.array(np.full(len(first), shard)), *(_blobs(ends, x[order]) for x in (keys, counts.astype(np.uint32)))]
        yield from _in_batches(pa.RecordBatch.from_arrays(columns, ["part", "shard", "keys", "counts"]))

    for keys, counts in grams:
        if len(keys):
            held.append((keys, counts))
        if sum(len(k) for k, _ in held) >= GATHER:
            yield from lot()
    if held:
        yield from lot()


def _sum_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: the counts of all shards summed; each shard hears which of its keys reach LEAST."""

    def gathered(rows: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        """Shards, the numbers of their keys, all keys, all counts."""
        found = []
        for own in rows:
            (offs, keys), (_, counts) = utf8(own.column("keys")), utf8(own.column("counts"))
            found.append((own.column("shard").to_numpy().copy(), np.diff(offs) // 8, keys.copy().view(np.uint64), counts.copy().view(np.uint32)))
        return [np.concatenate(x) for x in zip(*found)]

    for _, rows in _groups(batches, "part"):
        owners, sizes, every, counts = gathered(rows)
        enough = np.zeros(len(every), bool)
        slot = (every & np.uint64(15)).astype(np.uint8)
        for k in range(16):  # equal keys are in one slot
            order = np.flatnonzero(slot == k)
            order = order[np.argsort(every[order])]
            key = every[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            if len(key):
                reach = np.add.reduceat(counts[order], first, dtype=np.int64) >= LEAST
                enough[order] = np.repeat(reach, np.diff(np.append(first, len(key))))
        told = np.add.reduceat(enough, np.cumsum(sizes) - sizes, dtype=np.int64)
        rows = [pa.array(owners[told > 0]), _blobs(np.cumsum(told[told > 0]), every[enough])]
        del every, counts, enough, slot
        yield from _in_batches(pa.RecordBatch.from_arrays(rows, ["shard", "keys"]))
        pa.default_memory_pool().release_unused()


def _per_shard(work: Callable[..., Iterator[pa.RecordBatch]], depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls ``work(number, shard, keys)`` for each shard with the sorted keys that it was told."""

    def made(rows: Iterator[pa.RecordBatch]) -> tuple[Shard, np.ndarray]:
        lang, vocabulary, ids, keys = None, [], [], [np.zeros(0, np.uint64)]
        for own in rows:
            lang = next(iter(own.column("lang").drop_null().to_pylist()), lang)
            for column, to in (("vocabulary", vocabulary), ("ids", ids)):
                to += own.column(column).drop_null().to_pylist()
            keys.append(utf8(own.column("keys"))[1].copy().view(np.uint64))
        keys = np.concatenate(keys)
        keys.sort()
        return Shard(lang, b"".join(vocabulary), b"".join(ids), depth), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _groups(batches, "shard"):
            yield from work(number, *made(rows))
            pa.default_memory_pool().release_unused()

    return run


def _with_keys(rows: DataFrame, *told: DataFrame) -> DataFrame:
    """A shard's rows in order and its keys together in a task."""
    null = F.lit(None)
    out = rows.select("shard", "piece", "lang", "vocabulary", "ids", null.cast("binary").alias("keys"))
    for keys in told:
        out = out.union(keys.select("shard", null.cast("int"), null.cast("string"), null.cast("binary"), null.cast("binary"), "keys"))
    return out.repartition("shard").sortWithinPartitions("shard", "piece")


def _short(parts: int):
    def work(number: int, shard: Shard, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        one = shard.unigrams()
        grams = itertools.chain([one], map(shard.left, one.blocks()))
        yield from _dealt(number, ((shard.keys(g), g.count) for g in grams), parts)

    return work


def _long(parts: int):
    def work(number: int, shard: Shard, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        grams = shard.longer(_bigrams(shard, keys))
        yield from _dealt(number, ((shard.keys(g), g.count) for g in grams), parts)

    return work


def _texts(parts: int):
    def work(number: int, shard: Shard, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        two = _bigrams(shard, keys)
        held: dict[int, list[Grams]] = {}

        def lot(length: int) -> Iterator[pa.RecordBatch]:
            """N-grams of one length as a row per part."""
            g = Grams.joined(held.pop(length), length)
            order, part, first = _ranges(shard.keys(g), parts)
            ends, at = np.append(first[1:], len(part)), 0
            while at < len(first):
                to = max(at + 1, int(np.searchsorted(ends, first[at] + 4 * ROW, "right")))
                some, own = g.where(order[first[at] : ends[to - 1]]), first[at:to]
                offsets = pa.array(np.append(own, ends[to - 1]) - own[0], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (shard.texts(some), pa.array(some.count, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(part[own]), pa.array([shard.lang] * len(own), pa.string()), *lists], ["part", "lang", "phrases", "counts"])
                at = to

        for g in itertools.chain(shard.unigrams().blocks(), two.blocks(), shard.longer(two)):
            length = g.words.shape[1]
            held.setdefault(length, []).append(_kept(shard, g, keys))
            if sum(len(x.count) for x in held[length]) >= GATHER:
                yield from lot(length)
        for length in list(held):
            yield from lot(length)

    return work


def _sum_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: the phrases that reach LEAST, each once, with the sum of their counts."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
        return pa.table({"lang": sums.column("lang"), "phrase": sums.column("phrase"), "f": sums.column("f_sum")})

    for _, rows in _groups(batches, "part"):
        held, most = [], GATHER
        for own in rows:
            lists = own.column("phrases")
            listed = {"lang": own.column("lang").take(pc.list_parent_indices(lists)), "phrase": pc.list_flatten(lists), "f": pc.list_flatten(own.column("counts"))}
            held.append(summed([pa.table(listed)]))
            if sum(t.num_rows for t in held) >= most:
                held = [summed(held)]
                most = max(GATHER, 2 * held[0].num_rows)
        sums = summed(held)
        sums = sums.filter(pc.greater_equal(sums.column("f"), LEAST))
        words = pc.add(pc.count_substring(sums.column("phrase"), " "), 1).cast(pa.int32())
        yield from pa.table({"lang": sums.column("lang"), "phrase": sums.column("phrase"), "words": words, "f": sums.column("f")}).to_batches(ROW)
        pa.default_memory_pool().release_unused()


def frequent(rows: DataFrame) -> DataFrame:
    """(lang, phrase, words, f): the exact counts of all n-grams up to DEPTH words that occur LEAST times or more."""
    words = rows.agg(F.sum("words")).first()[0] or 0
    parts = max(1, -(-words // PART)) * 2
    packed, told = "part long, shard long, keys binary, counts binary", "shard long, keys binary"

    def summed(counts: DataFrame) -> DataFrame:
        return counts.repartition("part").sortWithinPartitions("part").mapInArrow(_sum_part, told)

    with _small_batches(rows.sparkSession):
        short = staged(summed(_with_keys(rows).mapInArrow(_per_shard(_short(parts), 2), packed)), "frequent-bigrams", **GROUPS)
        long = staged(summed(_with_keys(rows, short).mapInArrow(_per_shard(_long(parts), DEPTH), packed)), "frequent-longer", **GROUPS)
        found = _with_keys(rows, short, long).mapInArrow(_per_shard(_texts(parts), DEPTH), "part long, lang string, phrases array<string>, counts array<long>")
        sums = found.repartition("part").sortWithinPartitions("part").mapInArrow(_sum_texts, "lang string, phrase string, words int, f long")
        return staged(sums, "frequent-phrases")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    rows = shards(docs)
    counts = frequent(rows)
    total = rows.groupBy("lang").agg(F.sum("words").alias("n"))
    several = counts.where("words > 1").withColumnRenamed("f", "a").withColumn("word", F.split("phrase", " "))

    def words(first, length):
        return F.array_join(F.slice("word", first, length), " ")

    # The longer phrases are one word longer: what holds a phrase and is longer still is no more frequent.
    parts = several.where("words > 2").select(
        "lang", F.col("a").alias("more"), F.explode(F.array(words(F.lit(1), F.col("words") - 1), words(F.lit(2), F.col("words") - 1))).alias("phrase")
    )
    extended = parts.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    candidates = several.join(extended, ["lang", "phrase"], "left").where(F.col("more").isNull() | (100 * F.col("more") < COVER * F.col("a")))
    cuts = candidates.select("lang", "phrase", "a", "words", "word", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("head"), words(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS LONG)")
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    portion = F.pmod(F.xxhash64("phrase"), F.lit(PORTIONS))
    first = best.withColumn("place", F.row_number().over(W.partitionBy("lang", portion).orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op12_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
            FROM words, (VALUES (1), (2), (3), (4)) AS t(k)
        ), freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
        several AS (SELECT *, string_split(phrase, ' ') AS w FROM freq WHERE k > 1),
        inner_parts AS (
            SELECT lang, f, unnest(flatten([[array_to_string(w[i:i + j - 1], ' ') for i in range(1, k - j + 2)] for j in range(2, k)])) AS phrase
            FROM several WHERE k > 2
        ), covered AS (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY lang, phrase),
        kept AS (SELECT s.* FROM several s LEFT JOIN covered c USING (lang, phrase) WHERE c.most IS NULL OR 100 * c.most < 80 * s.f),
        cuts AS (
            SELECT lang, phrase, f AS a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)
        ), scored AS (
            SELECT c.lang, c.phrase, c.a, c.j, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a) // (h.f + t.f) AS score
            FROM cuts c JOIN freq h ON h.lang = c.lang AND h.phrase = c.head JOIN freq t ON t.lang = c.lang AND t.phrase = c.tail
        ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """
}
