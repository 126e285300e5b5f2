"""A Merkle manifest of a table, and proofs of its rows by octopus multiproofs.

Each row is a leaf. The leaves of a language, by doc_id, are a tree; the languages' subroots, by
language, are the leaves of a last tree, whose root stands for the table. A tree is built in tiles of
2**TILE leaves: a task hashes a tile up to its top, the tops are the leaves of the next round.

Proofs are made per leaf partition, ``PART`` consecutive leaves of the whole order, which may begin and
end anywhere in a tree and hold several trees, or any part of their leaves. A partition computes, level
by level, the coordinates of the siblings that it neither holds nor can derive (``missing``); these few
nodes are fetched by one join; then the partition derives the interior nodes that its proofs share, and
expands the proof of each leaf (``_expand``). What is fetched grows with the partitions and the height.

Leaves are numbered by sampled ranges and counts per range, so no task sees a language whole; the tree a
leaf belongs to comes back by a checked broadcast for large languages.

Defined results: a null field is ``-`` in its leaf, empty text ``0:``; a null doc_id comes first in its
language and is never tampered with; the null language comes first. Rows with the same doc_id lie by
leaf digest; rows repeated whole are leaves of their own. A tree of one leaf has that leaf as subroot;
a table of one row has no sibling, its proof digest is that of nothing. An empty table has no rows and
no root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.llm.common import join_facts, staged, table, whole_groups

#: Levels that a task builds at once, and leaves whose proofs it makes.
TILE = 10
PART = 3000
#: The tree over the subroots.
TOP = -1
_LOW = (1 << 33) - 1
NODE = "tree long, n long, level int, idx long, digest binary"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(n_chars: Column) -> Column:
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256))


def count_at(n: int, level: int) -> int:
    """Nodes of a tree of n leaves at a level."""
    return (n + (1 << level) - 1) >> level


def height(n: int) -> int:
    return (n - 1).bit_length()


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def missing(n: int, held: np.ndarray) -> list[tuple[int, int]]:
    """The fewest (level, index) that, with the leaves ``held`` of n, give the proofs of all of them."""
    out, now = [], np.unique(held)
    for level in range(height(n)):
        beside = now ^ 1
        beside = beside[beside < count_at(n, level)]
        out += [(level, int(i)) for i in np.setdiff1d(beside, now)]
        now = np.unique(now >> 1)
    return out


def _numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``at``, gapless from 0 in the order: row numbers of sampled ranges and counts of the ranges before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = staged(ranged, name)
    part = F.shiftright("at", 33).alias("part")
    counts = {r["part"]: r["n"] for r in rows.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    before = np.cumsum([0, *(counts[p] for p in sorted(counts))]).tolist()
    offsets = df.sparkSession.createDataFrame(list(zip(sorted(counts), before)), "part long, before long")
    rows = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return rows.withColumn("at", F.col("before") + F.col("at").bitwiseAND(F.lit(_LOW))).drop("part", "before")


def leaves(docs: DataFrame, part: int = PART) -> DataFrame:
    """(tree, n, idx, part, doc_id, digest, changed) of each row; ``changed`` is the digest after tampering."""
    doc_id, n_chars = F.col("doc_id"), F.col("n_chars")
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang_key"),
        leaf_digest(n_chars).alias("digest"),
        F.when(chosen, leaf_digest(n_chars.cast("decimal(20,0)") + 1)).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = staged(rows, "leaf-digests").withColumn("doc_null", F.col("doc_id").isNotNull())
    placed = staged(_numbered(rows, ["lang_key", "doc_null", "doc_id", "digest", "row"], "leaf-order"), "leaf-places")
    trees = placed.groupBy("lang_key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = staged(_numbered(trees, ["first"], "tree-order").withColumnRenamed("at", "tree"), "trees")
    joined = join_facts(placed, trees, ["lang_key"], "n", placed.count())
    place = [(F.col("at") - F.col("first")).alias("idx"), F.floor(F.col("at") / part).alias("part")]
    return staged(joined.select("tree", "n", *place, "doc_id", "digest", "changed"), "leaves")


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["tree", "n", "level", "idx", "digest"])


def _climb(level: int, levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["tree", "tile"], 20_000):
            out = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                tree, n, first = (t.column(c)[a].as_py() for c in ("tree", "n", "idx"))
                now = t.column("digest").slice(a, b - a).to_pylist()
                for up in range(level + 1, level + levels + 1):
                    if count_at(n, up - 1) == 1:
                        break
                    now, first = [node(now[i : i + 2]) for i in range(0, len(now), 2)], first >> 1
                    out += [(tree, n, up, first + i, d) for i, d in enumerate(now)]
            yield _nodes(out)

    return run


def tree_nodes(level0: DataFrame, tile: int = TILE) -> DataFrame:
    """(tree, n, level, idx, digest) of all nodes of the trees with these leaves (tree, n, idx, digest)."""
    now = level0.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    out, most = now, level0.agg(F.max("n")).first()[0] or 0
    for level in range(0, height(most) if most else 0, tile):
        tiled = now.withColumn("tile", F.shiftright("idx", tile)).repartition("tree", "tile").sortWithinPartitions("tree", "tile", "idx")
        made = staged(tiled.mapInArrow(_climb(level, tile), NODE), "tree-nodes")
        out, now = out.unionByName(made), made.where(F.col("level") == level + tile)
    return out


def manifest(docs: DataFrame, part: int = PART, tile: int = TILE) -> tuple[DataFrame, DataFrame, int, bytes | None]:
    """Leaves, nodes of all trees, the number of trees, and the root."""
    rows = leaves(docs, part)
    nodes = tree_nodes(rows.select("tree", "n", "idx", "digest"), tile)
    alone = F.floor((F.col("n") + F.expr("shiftleft(1L, level)") - 1) / F.expr("shiftleft(1L, level)")) == 1
    subroots = staged(nodes.where(alone).select("tree", "digest"), "subroots")
    n_trees = subroots.count()
    top = tree_nodes(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"), tile)
    root = top.where(alone).first()
    return rows, nodes.unionByName(top), n_trees, bytes(root["digest"]) if root else None


def _requests(n_trees: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["part", "tree"], 20_000):
            out = []
            part, tree, n, idx = (t.column(c).to_numpy() for c in ("part", "tree", "n", "idx"))
            trees: dict[int, list[int]] = {}
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                trees.setdefault(int(part[a]), []).append(int(tree[a]))
                out += [(part[a], tree[a], *c) for c in missing(int(n[a]), idx[a:b])]
            for p, held in trees.items():
                out += [(p, TOP, *c) for c in missing(n_trees, np.array(held))]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], ["part", "tree", "level", "idx"])

    return run


def _derive(n: int, held: dict[int, bytes], fetched: dict[tuple[int, int], bytes]) -> list[dict[int, bytes]]:
    """The nodes by level and index that the held leaves' proofs need; the last level has the root."""
    levels, now = [], held
    for level in range(height(n)):
        known = now | {i: d for (at, i), d in fetched.items() if at == level}
        levels.append(known)
        last = count_at(n, level)
        now = {i: node([known[c] for c in (2 * i, 2 * i + 1) if c < last]) for i in sorted({i >> 1 for i in now})}
    return [*levels, now]


def _proofs(n: int, levels: list[dict[int, bytes]], held: list[int]) -> dict[int, str]:
    """The siblings of each held leaf, from the leaf up, as hex text; what paths share is written once."""
    paths: dict[int, str] = {0: ""}
    wanted = [sorted(held)]
    for _ in range(height(n)):
        wanted.append(sorted({i >> 1 for i in wanted[-1]}))
    for level in range(height(n) - 1, -1, -1):
        known, last = levels[level], count_at(n, level)
        paths = {i: (known[i ^ 1].hex() if i ^ 1 < last else "") + paths[i >> 1] for i in wanted[level]}
    return paths


def _fold(digest: bytes, n: int, idx: int, levels: list[dict[int, bytes]]) -> bytes:
    """The root that a leaf gives with the original siblings."""
    for level in range(height(n)):
        beside = idx ^ 1
        if beside >= count_at(n, level):
            digest = node([digest])
        else:
            digest = node([digest, levels[level][beside]] if beside > idx else [levels[level][beside], digest])
        idx >>= 1
    return digest


def _expand(n_trees: int, root: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def proofs(t: pa.Table) -> Iterator[tuple]:
        fetched: dict[int, dict[tuple[int, int], bytes]] = {}
        held: dict[int, list[tuple]] = {}
        for tree, n, level, idx, digest, changed, doc_id, is_leaf in zip(*(t.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest", "changed", "doc_id", "is_leaf"))):
            if is_leaf:
                held.setdefault(tree, []).append((idx, n, digest, changed, doc_id))
            else:
                fetched.setdefault(tree, {})[level, idx] = digest
        trees = {tree: _derive(rows[0][1], {r[0]: r[2] for r in rows}, fetched.get(tree, {})) for tree, rows in held.items()}
        top = _derive(n_trees, {tree: levels[-1][0] for tree, levels in trees.items()}, fetched.get(TOP, {}))
        above = _proofs(n_trees, top, list(trees))
        for tree, rows in held.items():
            levels, subroot = trees[tree], trees[tree][-1][0]
            paths = _proofs(rows[0][1], levels, [r[0] for r in rows])
            for idx, n, digest, changed, doc_id in rows:
                folded = top[-1][0] if changed is None else _fold(_fold(changed, n, idx, levels), n_trees, tree, top)
                proof = hashlib.sha256((paths[idx] + above[tree]).encode()).hexdigest()
                yield doc_id, digest.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PROOF.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        for t, at in whole_groups(batches, ["part"], 1):
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                columns = zip(*proofs(t.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def prove(wanted: DataFrame, nodes: DataFrame, n_trees: int, root: bytes) -> DataFrame:
    """The proofs of the wanted leaves, checked against the root; ``wanted`` has any of the manifest's leaves."""
    places = wanted.select("part", "tree", "n", "idx").repartition("part").sortWithinPartitions("part", "tree", "idx")
    asked = staged(places.mapInArrow(_requests(n_trees), "part long, tree long, level int, idx long"), "asked-nodes")
    got = asked.distinct().join(nodes, ["tree", "level", "idx"])
    null = F.lit(None)
    held = wanted.select("part", "tree", "n", F.lit(0).alias("level"), "idx", "digest", "changed", "doc_id", F.lit(True).alias("is_leaf"))
    more = got.select("part", "tree", "n", "level", "idx", "digest", null.cast("binary").alias("changed"), null.cast("long").alias("doc_id"), F.lit(False).alias("is_leaf"))
    dealt = held.unionByName(more).repartition("part").sortWithinPartitions("part", "tree", "level", "idx")
    return dealt.mapInArrow(_expand(n_trees, root), PROOF)


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    rows, nodes, n_trees, root = manifest(table(spark, sf_dir, "documents"))
    return prove(rows, nodes, n_trees, root or b"")


SQL = {
    "op13_merkle_manifest": r"""
        WITH RECURSIVE raw AS (
            SELECT doc_id, source, lang, n_chars, text, coalesce('=' || lang, '') AS tree,
                list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(doc_id::VARCHAR, '')])),
                    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc
            FROM documents
        ), named AS (
            SELECT *,
                coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS before,
                coalesce(strlen(text) || ':' || text, '-') AS after,
                CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS more
            FROM raw
        ), hashed AS (
            SELECT doc_id, tree,
                sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || after) AS leaf,
                sha256(before || coalesce(strlen((n_chars + more)::VARCHAR) || ':' || (n_chars + more), '-') || after) AS given
            FROM named
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed
        ), up AS (
            SELECT tree, 0 AS level, pos AS idx, leaf AS digest, n AS cnt FROM leaves
            UNION ALL
            SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 1) // 2 FROM up
            WHERE cnt > 1 GROUP BY tree, level, idx // 2, cnt
        ), subroots AS (
            SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE cnt = 1
        ), top AS (
            SELECT 0 AS level, pos AS idx, subroot AS digest, n AS cnt FROM subroots
            UNION ALL
            SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 1) // 2 FROM top
            WHERE cnt > 1 GROUP BY level, idx // 2, cnt
        ), above AS (
            SELECT s.tree, string_agg(t.digest, '' ORDER BY t.level) AS path FROM subroots s
            JOIN top t ON t.cnt > 1 AND t.idx = xor(s.pos >> t.level, 1) GROUP BY s.tree
        ), paths AS (
            SELECT l.tree, l.pos, string_agg(u.digest, '' ORDER BY u.level) AS path FROM leaves l
            JOIN up u ON u.tree = l.tree AND u.cnt > 1 AND u.idx = xor(l.pos >> u.level, 1) GROUP BY l.tree, l.pos
        ), fold AS (
            SELECT tree, pos, 0 AS level, pos AS idx, given AS digest, n AS cnt FROM leaves
            UNION ALL
            SELECT f.tree, f.pos, f.level + 1, f.idx // 2,
                sha256(CASE WHEN u.idx IS NULL THEN f.digest WHEN u.idx < f.idx THEN u.digest || f.digest ELSE f.digest || u.digest END), (f.cnt + 1) // 2
            FROM fold f LEFT JOIN up u ON u.tree = f.tree AND u.level = f.level AND u.idx = xor(f.idx, 1) WHERE f.cnt > 1
        ), refold AS (
            SELECT f.tree, f.pos, 0 AS level, s.pos AS idx, f.digest, s.n AS cnt FROM fold f JOIN subroots s USING (tree) WHERE f.cnt = 1
            UNION ALL
            SELECT f.tree, f.pos, f.level + 1, f.idx // 2,
                sha256(CASE WHEN t.idx IS NULL THEN f.digest WHEN t.idx < f.idx THEN t.digest || f.digest ELSE f.digest || t.digest END), (f.cnt + 1) // 2
            FROM refold f LEFT JOIN top t ON t.level = f.level AND t.idx = xor(f.idx, 1) WHERE f.cnt > 1
        ), root AS (SELECT digest AS root FROM top WHERE cnt = 1)
        SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.path, '') || coalesce(a.path, '')) AS proof_sha256,
            f.digest AS folded_root, f.digest = r.root AS verified
        FROM leaves l JOIN subroots s USING (tree) LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos
        LEFT JOIN above a ON a.tree = l.tree JOIN refold f ON f.tree = l.tree AND f.pos = l.pos AND f.cnt = 1 CROSS JOIN root r
    """
}
