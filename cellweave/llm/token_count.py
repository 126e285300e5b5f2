"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary entry that ends at each character; dynamic
programming keeps the best score and the number of pieces there, no back pointers and no pieces.
Ties follow the tokenizer: at one end, candidates come from the earliest start on and only a strictly
greater score replaces; a character without a piece of its own costs the least score minus 10 and
counts as its UTF-8 bytes (byte fallback).

The installed vocabulary files hold no unigram model, so the pieces of ``piece_bpe_32k.model`` are
scored by a rule: minus the natural logarithm of their rank plus 2. Scores are multiples of 2**-16,
so that sums are exact in doubles, in any order, to 2**37. That makes it exact to count a text by the
chunks between a space and the next: no piece has a space after another character. Distinct chunks
are counted once per task (a bounded cache); texts are never cut otherwise. No shuffle.

Defined results: null and empty text have no tokens and score 0. Repeated rows each give their row.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cellweave.llm.common import id_text, pieces, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
UNIT = 1 << 16
UNKNOWN_PENALTY = 10.0
CACHE = 200_000
CHUNK = 4 << 20
SCHEMA = "doc_id long, n_chars long, n_tokens long, score double"


def load_vocabulary(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces with exact scores, in the order of their ids. Executors read the file where it is installed.

    Control, unknown and byte pieces are no text: one that is written out is counted like any other text.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    out, rank = [], 0
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            out.append((model.id_to_piece(i), -round(math.log(rank + 2) * UNIT) / UNIT))
            rank += 1
    return out


class Counter:
    """Best score and piece count of texts."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.cache: dict[str, tuple[int, float]] = {}
        mark = re.escape(SPACE_MARK)
        self.chunks = re.compile(f"{mark}*[^{mark}]+|{mark}+").findall
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in vocabulary):
            raise ValueError("a piece spans a space: texts can't be counted by chunks")

    def viterbi(self, chunk: str) -> tuple[int, float]:
        n = len(chunk)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at, best, pieces_, single = 1, None, 0, False  # the end being filled

        def close() -> None:
            nonlocal best, pieces_
            if not single:  # no piece for the character itself
                other = score[at - 1] + self.unknown
                if best is None or other > best:
                    best, pieces_ = other, count[at - 1] + len(chunk[at - 1].encode("utf-8", "surrogatepass"))
            score[at], count[at] = best, pieces_

        for end, (length, own) in self.automaton.iter(chunk):
            while at <= end:
                close()
                at, best, single = at + 1, None, False
            total = score[end + 1 - length] + own
            if best is None or total > best:  # longest match first: the earliest start wins ties
                best, pieces_ = total, count[end + 1 - length] + 1
            single |= length == 1
        while at <= n:
            close()
            at, best, single = at + 1, None, False
        return count[n], score[n]

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        tokens, total, cache = 0, 0.0, self.cache
        for chunk in self.chunks(SPACE_MARK + text.replace(" ", SPACE_MARK)):
            found = cache.get(chunk)
            if found is None:
                found = self.viterbi(chunk)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(chunk) <= 64:
                    cache[chunk] = found
            tokens += found[0]
            total += found[1]
        return tokens, total


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: characters, tokens and the best segmentation's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load_vocabulary(model))
        for batch in pieces(batches, "text", CHUNK):
            texts = batch.column("text").to_pylist()
            found = [counter(t) for t in texts]
            columns = [
                batch.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_tokens", "score"])

    return id_text(docs).mapInArrow(run, SCHEMA)


def op6_token_count(spark, sf_dir) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
