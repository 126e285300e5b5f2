"""Language identification by a byte convolutional network.

Bytes get a small embedding; filters of widths 2, 3 and 4 slide over it, each filter's maximum over a
fixed-length window (max pooling) goes through a rectifier and a softmax layer. It is trained in numpy
with Adam on the driver: on one window, at a seeded place, of each of TRAIN_ROWS labelled documents,
the first in the order of a hash of their id. That bound is a parameter; predictions read every text
whole, in batches of windows, and average the windows' probabilities.

In tasks the convolution is a sum of table rows: a filter's response to a pair of bytes is looked up,
not multiplied out. The network travels with the task (some kilobytes). No shuffle but for the sample.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so is everything if
there is nothing to learn from. A null doc_id is not held out and not learned from. Repeated rows each
give their row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm.common import pieces, table, utf8

WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
WINDOW = 256
TRAIN_ROWS = 4000
EPOCHS = 8
BATCH = 64
RATE = 0.01
SEED = 7
CHUNK = 1 << 20
BLOCK_WINDOWS = 64
#: Below this the pipeline rejects a document; the best of four languages has 0.25 at least.
LEAST_SCORE = 0.3
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
TAIL = max(WIDTHS) - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows as bytes (zero padded), class numbers, and the classes in order.

    Hashes above a threshold are left out first, for some 2 * ``rows`` candidates; it rises while they hold
    fewer than ``rows`` documents with letters. So tasks send little, however many they are.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    learn = known.where(F.col("text").rlike(r"\p{L}"))
    length = F.length("text")
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.greatest(length - WINDOW + 1, F.lit(1)))
    sample = learn.select(
        F.col("lang").cast("string").alias("lang"), F.substring("text", (place + 1).cast("int"), F.lit(WINDOW)).alias("piece"),
        F.xxhash64("doc_id").alias("h"), "doc_id",
    )
    share = min(1.0, 2 * rows / max(known.count(), 1))
    got = []
    while len(got) < rows:
        below = F.col("h") <= int(share * 2**64) - 2**63 - 1
        got = sample.where(below).orderBy("h", "doc_id", "lang", "piece").limit(rows).collect()
        if share == 1:
            break
        share = min(1.0, 4 * share)
    langs = sorted({r["lang"] for r in got})
    x = np.zeros((len(got), WINDOW + TAIL), np.uint8)
    for i, r in enumerate(got):
        raw = np.frombuffer(r["piece"].encode()[: WINDOW + TAIL], np.uint8)
        x[i, : len(raw)] = raw
    return x, np.array([langs.index(r["lang"]) for r in got], np.int64), langs


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled responses, the places they come from, the hidden layer."""
    e = net["embed"][x]
    n = x.shape[1] - TAIL
    pooled, places = [], []
    for w in WIDTHS:
        y = sum(e[:, j : j + n] @ net[f"k{w}"][j] for j in range(w))
        at = y.argmax(axis=1)
        places.append(at)
        pooled.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
    pooled, places = np.concatenate(pooled, 1), np.concatenate(places, 1)
    return pooled, places, np.maximum(pooled + net["b"], 0)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, n_classes: int) -> dict[str, np.ndarray]:
    """The network's weights. Classes weigh the same, however many windows they have."""
    rng = np.random.default_rng(SEED)
    total = FILTERS * len(WIDTHS)
    net = {"embed": rng.normal(0, 0.3, (256, EMBED)), "b": np.zeros(total), "v": rng.normal(0, 0.3, (total, n_classes)), "c": np.zeros(n_classes)}
    net |= {f"k{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    m, s, t = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    counts = np.bincount(y, minlength=n_classes)
    weight = (len(y) / (n_classes * np.maximum(counts, 1))).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            xb, yb = x[rows], y[rows]
            _, places, hidden = _forward(net, xb)
            d = softmax(hidden @ net["v"] + net["c"])
            d[np.arange(len(yb)), yb] -= 1
            d *= weight[yb, None] / len(yb)
            back = (d @ net["v"].T) * (hidden > 0)
            grad = {"v": hidden.T @ d, "c": d.sum(0), "b": back.sum(0), "embed": np.zeros_like(net["embed"])}
            for i, w in enumerate(WIDTHS):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                at, own = places[:, part], back[:, part]
                g = np.zeros_like(net[f"k{w}"])
                for j in range(w):
                    chars = np.take_along_axis(xb, at + j, 1)
                    g[j] = np.einsum("bfd,bf->df", net["embed"][chars], own)
                    np.add.at(grad["embed"], chars, own[:, :, None] * net[f"k{w}"][j].T[None])
                grad[f"k{w}"] = g
            t += 1
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                net[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return net


def tables(net: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Responses by lookup: to the first two bytes for all widths, to a third, to a second pair."""
    one = {(w, j): net["embed"] @ net[f"k{w}"][j] for w in WIDTHS for j in range(w)}
    pair = lambda w, j: (one[w, j][:, None] + one[w, j + 1][None]).reshape(65536, FILTERS)
    return np.concatenate([pair(w, 0) for w in WIDTHS], 1), one[3, 2], pair(4, 2)


def window_probabilities(net: dict, lookup: tuple, data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Probabilities for each window of ``data``, whose length is a multiple of the window, plus the tail.

    ``last``: windows that end a text; the bytes after them are another's and count as zeros.
    """
    first, third, second_pair = lookup
    zeros = first[0].copy()
    zeros[FILTERS : 2 * FILTERS] += third[0]
    zeros[2 * FILTERS :] += second_pair[0]
    n, out = (len(data) - TAIL) // WINDOW, []
    for start in range(0, n, BLOCK_WINDOWS):
        count = min(BLOCK_WINDOWS, n - start)
        size = count * WINDOW
        part = data[start * WINDOW : start * WINDOW + size + TAIL].astype(np.int32)
        pairs = part[:-1] * 256 + part[1:]
        y = first[pairs[:size]]
        y[:, FILTERS : 2 * FILTERS] += third[part[2 : 2 + size]]
        y[:, 2 * FILTERS :] += second_pair[pairs[2 : 2 + size]]
        y = y.reshape(count, WINDOW, -1)
        y[last[start : start + count], WINDOW - TAIL :] = zeros
        out.append(y.max(axis=1))
    hidden = np.maximum(np.concatenate(out) + net["b"], 0)
    return softmax(hidden @ net["v"] + net["c"])


def text_probabilities(net: dict, lookup: tuple, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Mean probabilities over the windows of each text (which has a byte at least)."""
    sizes = np.diff(offs)
    windows = -(-(sizes + TAIL) // WINDOW)  # the last TAIL bytes of a text's last window are zeros
    ends = np.cumsum(windows)
    laid = np.zeros(int(ends[-1]) * WINDOW + TAIL, np.uint8)
    shift = (ends - windows) * WINDOW - offs[:-1]
    laid[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    last = np.zeros(int(ends[-1]), bool)
    last[ends - 1] = True
    p = window_probabilities(net, lookup, laid, last)
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(len(text)) - np.repeat(ends - windows, windows)
    p[place * WINDOW >= np.maximum(sizes[text], 1)] = 0  # windows of zeros alone
    sums = np.add.reduceat(p, ends - windows, axis=0)
    return sums / sums.sum(axis=1, keepdims=True)


def best_languages(net: dict, lookup: tuple, n: int, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class and score of each text; class n and score 0 for those without bytes."""
    offs, data = utf8(column)
    best, score = np.full(len(column), n), np.zeros(len(column))
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        p = text_probabilities(net, lookup, np.append(offs[some], offs[-1]), data)
        best[some], score[some] = p.argmax(axis=1), p.max(axis=1)
    return best, score


def predict(docs: DataFrame, net: dict | None, langs: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row with doc_id and text."""
    readable = F.col("text").rlike(r"\p{L}") if net else F.lit(False)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.when(readable, F.col("text")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = tables(net) if net else None
        names = np.array([*langs, "und"], object)
        for batch in pieces(batches, "text", CHUNK):
            best, score = best_languages(net, lookup, len(langs), batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` that have a language: a letter, and a score that is no mere guess.

    Without anything to learn from, the rows with a letter.
    """
    readable = docs.where(F.col("text").rlike(r"\p{L}"))
    x, y, langs = training_windows(docs)
    if not langs:
        return readable
    net = train(x, y, len(langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = tables(net)
        for batch in pieces(batches, "text", CHUNK):
            _, score = best_languages(net, lookup, len(langs), batch.column("text"))
            yield batch.filter(pa.array(score >= least))

    return readable.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict all."""
    x, y, langs = training_windows(docs)
    net = train(x, y, len(langs)) if langs else None
    return predict(docs, net, langs)


def op8_language_id(spark, sf_dir) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
