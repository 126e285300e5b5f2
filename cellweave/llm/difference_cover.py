"""Equal substrings of a text in memory: blockwise suffix sorting with a difference cover sample.

A difference cover D modulo v has, for any two places i and j, a shift d < v such that i + d and j + d
are both in the sample (the places whose remainder is in D). The sample's suffixes are ranked first, to
the depth that matters, by prefix doubling in steps of v. Then one bucket of suffixes is sorted at a
time: by its first v bytes, and where these tie, by the ranks of the sample at the common shift. Only
one bucket's sort keys exist at once.
"""

from __future__ import annotations

import numpy as np

V = 32
BUCKET = 1 << 17


def difference_cover(v: int) -> list[int]:
    """Greedy: add the number that brings the most new differences, until all are there."""
    cover, have = [0], {0}
    while len(have) < v:
        gain = lambda c: len({d for x in [*cover, c] for d in ((c - x) % v, (x - c) % v)} - have)
        best = max(range(v), key=lambda c: (gain(c), -c))
        cover.append(best)
        have |= {d for x in cover for d in ((best - x) % v, (x - best) % v)}
    return sorted(cover)


def _dense(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by the columns, and each row's dense rank."""
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(change)
    return order, rank


class CoverSample:
    """Ranks of the sample's suffixes by their first ``depth`` bytes or more, and where neighbours part."""

    def __init__(self, text: np.ndarray, depth: int, v: int = V) -> None:
        self.v, self.depth, n = v, depth, len(text)
        cover = difference_cover(v)
        padded = np.concatenate([text, np.zeros(depth + 2 * v + 8, np.uint8)])
        w = padded.astype(np.uint64)
        for k in (1, 2, 4):  # eight bytes from each place on, as one number
            w = (w[:-k] << np.uint64(8 * k)) | w[k:]
        self.word = w
        member = np.zeros(v, bool)
        member[cover] = True
        place = np.flatnonzero(member[np.arange(n) % v])
        self.number = np.full(n + depth + 2 * v, -1, np.int64)
        self.number[place] = np.arange(len(place))
        _, rank = _dense([w[place + 8 * k] for k in range(v // 8)])
        reach = v
        while reach < depth:  # a place plus a multiple of v is in the sample too
            follow = self.number[np.minimum(place + reach, len(self.number) - 1)]
            _, rank = _dense([rank, np.where(follow >= 0, rank[follow], -1)])
            reach *= 2
        self.rank = rank
        one = np.empty(int(rank.max()) + 1 if len(rank) else 0, np.int64)
        one[rank] = place  # a place of each rank, in the order of ranks
        self.common = np.full(len(one), 0, np.int64)
        for a in range(1, len(one), 1 << 16):
            b = min(len(one), a + (1 << 16))
            self.common[a:b] = self._common(one[a - 1 : b - 1], one[a:b])
        # The least shift for each pair of remainders.
        shift = np.full((v, v), v, np.int64)
        for d in reversed(range(v)):
            at = member[(np.arange(v) + d) % v]
            shift[np.ix_(at, at)] = d
        self.shift = shift
        self._levels: dict[int, np.ndarray] = {}

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, up to the depth."""
        out, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(0, self.depth, 8):
            x = self.word[a + k] ^ self.word[b + k]
            equal = x == 0
            # Equal leading bytes of the first word that differs.
            lead = np.zeros(len(a), np.int64)
            for byte in range(7):
                lead += (x >> np.uint64(56 - 8 * byte)) == 0
            out += np.where(same, np.where(equal, 8, lead), 0)
            same &= equal
        return np.minimum(out, self.depth)

    def classes_at(self, places: np.ndarray, length: int) -> np.ndarray:
        """Numbers of sample places that are equal when their first ``length`` bytes are."""
        if length not in self._levels:
            self._levels[length] = np.cumsum(self.common < length)
        return self._levels[length][self.rank[self.number[places]]]


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int, v: int = V) -> np.ndarray:
    """A number for each window text[s : s + length]; equal numbers for equal windows. length >= v."""
    label = np.arange(len(starts))
    if not len(starts):
        return label
    sample = CoverSample(text, length, v)
    head = sample.word[starts]
    n_buckets = -(-len(starts) // BUCKET)
    splitters = np.unique(np.quantile(head.astype(np.float64), np.arange(1, n_buckets) / n_buckets).astype(np.uint64)) if n_buckets > 1 else head[:0]
    bucket = np.searchsorted(splitters, head, "right")
    for k in range(len(splitters) + 1):
        rows = np.flatnonzero(bucket == k)
        if len(rows):
            _resolve(sample, starts, rows, label)
    return label


def _resolve(sample: CoverSample, starts: np.ndarray, rows: np.ndarray, label: np.ndarray) -> None:
    """Sort a bucket by the first v bytes; label ties that are equal to the full length."""
    v, length = sample.v, sample.depth
    _, group = _dense([sample.word[starts[rows] + 8 * k] for k in range(v // 8)])
    tied = np.bincount(group)[group] > 1
    rows, group = rows[tied], group[tied]
    rest = starts[rows] % v
    seen: list[tuple[int, np.ndarray, np.ndarray]] = []  # per remainder: rows that stand for themselves, groups
    for b in np.unique(rest).tolist():
        mine = rest == b
        own, own_group = rows[mine], group[mine]
        for a, other, other_group in [*seen, (b, None, None)]:
            if not len(own):
                break
            d = int(sample.shift[a, b])
            key = own_group * (len(sample.common) + 1) + sample.classes_at(starts[own] + d, length - d)
            if other is None:  # same remainder: the first of equal keys stands for all
                _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                label[own] = label[own[first]][inverse]
                own, own_group = own[first], own_group[first]
                break
            known = other_group * (len(sample.common) + 1) + sample.classes_at(starts[other] + d, length - d)
            order = np.argsort(known)
            at = np.minimum(np.searchsorted(known, key, sorter=order), len(known) - 1)
            match = known[order[at]] == key
            label[own[match]] = label[other[order[at[match]]]]
            own, own_group = own[~match], own_group[~match]
        if len(own):
            seen.append((b, own, own_group))
