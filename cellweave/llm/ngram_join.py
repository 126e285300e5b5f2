"""Self-join of documents on the Jaccard similarity of their word 5-grams, by adaptive prefixes.

A document is the set of its 64-bit shingle hashes. Equal sets are one class. Sets whose Jaccard is 0.8
or more share a token of their prefixes: the first n - ceil(0.8 n) + 1 of n tokens in one global order,
here by a count sketch over all documents (rare first), then by hash. The steps:

1. one pass for sizes, 128-bit set hashes and the sketch (COUNT_BUCKETS numbers, whatever the input);
2. one pass that gives (token, class) for the prefixes, each lengthened by ``matches(n)`` - 1 tokens, so
   that similar sets share as many tokens of both prefixes as the smaller ``matches`` asks. Tokens of one
   class alone drop out; then classes with too few tokens left for any partner, and with them the
   documents that merely hold a passage others hold too;
   The least class of a token leads it, and a class joins the families of its tokens' leaders. Classes
   that share a token are together in its leader's family; copies with small edits share most leaders,
   so a family replaces their many token lists and no pair is ever written out;
3. the families' texts are fetched and joined family by family, with multi-match prefixes: a document
   that probes the index lengthens its prefix by l - 1 tokens and asks l shared tokens of a candidate,
   l chosen for each document by the estimated cost of scanning the lists and of verifying what is left.
   Pairs that are connected already are not verified again; each verified link that connects is an edge;
4. components of the edges, and the least doc_id of each.

Families above FAMILY classes are dealt over tasks by pairs of blocks, so that memory is bounded and no
pair is left out. Equal sets never meet in a task; facts of large classes go back by a checked broadcast.

Defined results: null or empty text, or text of white space, has the empty set, 0 shingles and its own
doc_id as component; texts with fewer than five words are one shingle; rows with the same doc_id but
different texts are documents of their own; a null doc_id takes part and is never the least, a component
of null ids alone has the component null. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cellweave.llm.common import id_text, join_facts, mix64, pieces, powers, staged, table, text_or_empty, utf8, whole_groups
from cellweave.llm.components import components

N = 5
PERCENT = 80
COUNT_BITS = 18
FAMILY = 4096
#: One in so many tokens lengthens the prefix, and has to be shared.
MATCH_PART = 10
MOST_MATCHES = 8
#: Cost of verifying a candidate, in list entries scanned.
VERIFY_COST = 400
CHUNK = 1 << 20
SEEN = 200_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Shingle hash sets of the texts of a batch."""

    def __init__(self) -> None:
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        lower = np.arange(256)
        lower[65:91] += 32
        self.byte = self.byte[lower]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.up, self.down = powers(_BASE, 1), powers(_INVERSE, 1)

    def words(self, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the bounds of each text in them."""
        n = len(data)
        if n > len(self.up):
            self.up, self.down = powers(_BASE, n), powers(_INVERSE, n)
        solid = ~self.space[data]
        edge = np.zeros(n + 1, bool)  # a text begins here, or the last one ends
        edge[offs] = True
        before = np.concatenate([[False], solid[:-1]]) if n else solid
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.concatenate([solid[1:], [False]]) if n else solid
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.up[:n], dtype=np.uint64)])
        hashes = (sums[ends] - sums[starts]) * self.down[starts] if n else np.zeros(0, np.uint64)
        return mix64(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offs)

    def sets(self, offs: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        words, at = self.words(offs, data)
        salted = [mix64(words + np.uint64((j + 1) * _BASE % (1 << 64))) for j in range(N)]
        count = max(len(words) - N + 1, 0)
        whole = mix64(sum(s[j : j + count] for j, s in enumerate(salted))) if count else words[:0]
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= N:
                h = np.sort(whole[a : b - N + 1])
                out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
            elif b > a:
                h = np.array([b - a], np.uint64)
                for j in range(b - a):
                    h += salted[j][a + j]
                out.append(mix64(h))
            else:
                out.append(words[:0])
        return out


def set_hash(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    one, two = mix64(tokens).sum(dtype=np.uint64), mix64(tokens ^ _SECOND).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def needed(n: int) -> int:
    """The least overlap of a set of n tokens with any similar one."""
    return -(-PERCENT * n // 100)


def matches(n: int) -> int:
    """Shared prefix tokens asked of a set of n tokens before its text is fetched."""
    return max(1, n // MATCH_PART)


def _batch_sets(shingler: Shingler, column: pa.Array) -> list[np.ndarray]:
    return shingler.sets(*utf8(column))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, counts = Shingler(), np.zeros(1 << COUNT_BITS, np.int64)
    names = ["kind", "id", "text_hash", "n", "h1", "h2"]
    for batch in pieces(batches, "text", CHUNK):
        sets = _batch_sets(shingler, batch.column("text"))
        hashes = [set_hash(s) for s in sets]
        counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(sets), np.int8)), batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()),
             pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64())], names)
    at = np.flatnonzero(counts)
    zero = np.zeros(len(at), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int8)), *map(pa.array, (at, zero, counts[at], zero, zero))], names)


def document_facts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, h1, h2) of each row, and the sketch (bucket, n)."""
    hashed = id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    both = staged(hashed.mapInArrow(_facts, "kind byte, id long, text_hash long, n long, h1 long, h2 long"), "shingle-facts")
    rows = both.where("kind = 0").select(F.col("id").alias("doc_id"), "text_hash", "n", "h1", "h2")
    return rows, both.where("kind = 1").groupBy(F.col("id").alias("bucket")).agg(F.sum("n").alias("n"))


def prefix_tokens(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, h1) for the prefixes; repeats of a set inside a task only once."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, seen = Shingler(), shared.value, set()
        for batch in pieces(batches, "text", CHUNK):
            tokens, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s in _batch_sets(shingler, batch.column("text")):
                if not len(s):
                    continue
                key = set_hash(s)
                if key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                size = len(s) - needed(len(s)) + matches(len(s))
                order = np.argsort(counts[(s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], kind="stable")[:size]
                tokens.append(s[order])
                owners.append(np.full(size, key[0], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners))], ["token", "h1"])

    return id_text(docs).mapInArrow(run, "token long, h1 long")


def families(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(leader, h1): classes that share a prefix token, under the least class of the token.

    A class of n tokens stays if it has as many shared tokens as its smallest possible partner, of
    ``needed(n)`` tokens, asks for.
    """
    of_token = W.partitionBy("token")
    led = lambda df: df.select(
        "token", "h1", F.min("h1").over(of_token).alias("leader"), F.max("h1").over(of_token).alias("last")
    ).where("leader <> last")
    shared = staged(led(tokens).select("token", "h1"), "shared-tokens")
    least = F.ceil(F.col("n") * PERCENT / 100)
    asked = F.greatest(F.floor(least / MATCH_PART), F.lit(1))
    enough = shared.groupBy("h1").agg(F.countDistinct("token").alias("k")).join(classes.select("h1", "n"), "h1").where(F.col("k") >= asked)
    return led(shared.join(enough.select("h1"), "h1", "left_semi")).select("leader", "h1").distinct()


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a


def similar(a: int, b: int, common: int) -> bool:
    return 100 * common >= PERCENT * (a + b - common)


def join_family(sets: list[np.ndarray], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all similar pairs of the sets; with sides, only pairs of different sides count.

    Tokens are ordered by their number of sets here. Sets are probed by size, then indexed: level 1 of
    the index has the prefixes, level l > 1 the one token by which the l-prefix is longer.
    """
    every, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(every))
    bounds = np.cumsum([0, *map(len, sets)])
    ordered = [np.sort(rank[inverse[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]
    members: list[set | None] = [None] * len(sets)
    sizes = np.array(list(map(len, sets)))
    index: list[dict[int, list[int]]] = [{} for _ in range(MOST_MATCHES)]
    union, links = _Union(len(sets)), []

    def member(i: int) -> set:
        if members[i] is None:
            members[i] = set(ordered[i].tolist())
        return members[i]

    for x in np.argsort(sizes, kind="stable").tolist():
        tokens, n = ordered[x].tolist(), int(sizes[x])
        least = needed(n)
        start = n - least + 1
        # Lists met with l = 1, then longer prefixes while the estimated cost falls.
        best, chosen = None, []
        lists: list[list[int]] = [index[0][t] for t in tokens[:start] if t in index[0]]
        scanned = sum(map(len, lists))
        for l in range(1, MOST_MATCHES + 1):  # noqa: E741
            if l > 1:
                if start + l - 1 > n:
                    break
                last = tokens[start + l - 2]
                more = [index[k][last] for k in range(l - 1) if last in index[k]]
                more += [index[l - 1][t] for t in tokens[: start + l - 1] if t in index[l - 1]]
                lists = lists + more
                scanned += sum(map(len, more))
            cost = scanned + VERIFY_COST * scanned / l
            if best is not None and cost >= best[0]:
                break
            best, chosen = (cost, l), lists
        if chosen:
            flat = np.fromiter((i for one in chosen for i in one), np.int64)
            hits = np.bincount(flat, minlength=len(sets))
            found = np.flatnonzero(hits >= best[1])
            found = found[sizes[found] * 100 >= PERCENT * n]
            for y in found[np.argsort(-hits[found], kind="stable")].tolist():
                if sides is not None and sides[x] == sides[y]:
                    continue
                a, b = union.root(x), union.root(y)
                if a != b and similar(n, int(sizes[y]), len(member(x) & member(y))):
                    union.up[a] = b
                    links.append((x, y))
        for k, level in enumerate(index):
            own = tokens[:start] if k == 0 else tokens[start + k - 1 : start + k]
            for t in own:
                level.setdefault(t, []).append(x)
    return links


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for t, at in whole_groups(batches, ["leader", "i", "j"], 500):
        sets: list[np.ndarray] = []
        for part in pieces(t.to_batches(), "text", CHUNK):
            sets += _batch_sets(shingler, part.column("text"))
        i, j, side = (t.column(k).to_numpy() for k in ("i", "j", "block"))
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            keys = [set_hash(s) for s in sets[a:b]]
            first = {k: n for n, k in reversed(list(enumerate(keys)))}
            rows = [n for n in sorted(first.values()) if len(sets[a + n])]
            if len(rows) > 1:
                sides = side[a:b][rows].tolist() if i[a] != j[a] else None
                out += [(*keys[rows[x]], *keys[rows[y]]) for x, y in join_family([sets[a + n] for n in rows], sides)]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["a1", "a2", "b1", "b2"])


def links(docs: DataFrame, classes: DataFrame, member: DataFrame, family: int = FAMILY) -> DataFrame:
    """Edges (u, v) between classes, as structs of their hashes, that connect all similar pairs."""
    sizes = member.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / family).alias("blocks"))
    dealt = member.join(sizes, "leader").join(classes.select("h1", "rep", "rep_hash"), "h1")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("h1"), "blocks"))
    # Rows that share an id, or have none, are told apart by their text's hash.
    wanted = dealt.groupBy("rep", "rep_hash").agg(F.collect_set(F.struct("leader", "blocks", "block")).alias("places"))
    texts = id_text(docs).withColumn("hash", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("hash") == F.col("rep_hash")))
    placed = texts.select("text", F.explode("places").alias("p")).select("text", "p.*")
    # A class of block b is needed for the pairs (b, k) and (k, b).
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rows = placed.select("leader", "block", "text", F.explode(pairs).alias("q")).select("leader", "q.i", "q.j", "block", "text")
    found = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(_join, "a1 long, a2 long, b1 long, b2 long")
    node = lambda s: F.struct(F.col(f"{s}1").alias("h1"), F.col(f"{s}2").alias("h2"))
    return found.select(node("a").alias("u"), node("b").alias("v"))


def similar_groups(docs: DataFrame, family: int = FAMILY) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row."""
    rows, sketch = document_facts(docs)
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for r in sketch.toLocalIterator():
        counts[r["bucket"]] = r["n"]
    # Of the rows with the least id, and of those without one, the least hash.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    of_class = [first, F.count(F.lit(1)).alias("rows"), F.first("n").alias("n")]
    classes = rows.where("n > 0").groupBy("h1", "h2").agg(*of_class)
    classes = staged(classes.select("h1", "h2", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash"), "rows", "n"), "classes")
    member = staged(families(prefix_tokens(docs, counts), classes), "families")
    roots = components(links(docs, classes, member, family)).select("node.h1", "node.h2", "root")
    linked = roots.join(classes, ["h1", "h2"]).select("h1", "h2", "root", "rep", "rows")
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    facts = (
        linked.join(least, "root").select("h1", "h2", "component_id", "rows")
        .unionByName(classes.join(roots, ["h1", "h2"], "left_anti").select("h1", "h2", F.col("rep").alias("component_id"), "rows"))
    )
    facts = staged(facts, "class-facts")
    some = join_facts(rows.where("n > 0"), facts, ["h1", "h2"], "rows", rows.count())
    return some.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id").unionByName(
        rows.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's; of rows repeated whole, one."""
    groups = similar_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.select(F.col("doc_id").alias("kept"), "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("hash"), F.xxhash64("*").alias("all"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    before = F.lag("all").over(W.partitionBy("id", "hash").orderBy("all"))
    return rows.withColumn("again", before.eqNullSafe(F.col("all"))).where("NOT again").select("row.*")


def op7_ngram_join(spark, sf_dir) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
