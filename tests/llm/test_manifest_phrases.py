"""SimHash groups, collocations and the Merkle manifest, against brute force, SQL and odd tables."""

import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cellweave.llm import merkle, phrases, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, table_of, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    odd = [(*r, 0) for r in odd_rows]
    return {"odd": (table_of(odd_rows).repartition(3), odd), "small": (docs, small), "empty": (table_of([]), [])}


KINDS = ("odd", "small", "empty")


# --- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    up = list(range(len(fps)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("bucket,m", [(1 << 16, None), (3, 4), (5, 3), (1 << 16, 2)])
def test_simhash_groups(tables, kind, bucket, m):
    docs, rows = tables[kind]
    got = simhash.near_groups(docs, bucket, m).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(fps)
    least = collections.defaultdict(list)
    for r, root in zip(rows, roots):
        least[root].append(r[0])
    want = collections.Counter((r[0], f, min((i for i in least[root] if i is not None), default=None)) for r, f, root in zip(rows, fps, roots))
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_a_crowd_of_near_fingerprints_gives_one_link_each(spark):
    rng = np.random.default_rng(4)
    crowd = {int.from_bytes(b"crowded!") ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 4, 3000)}
    fps = np.array(sorted(crowd | set(rng.integers(0, 1 << 63, 500).tolist())), np.uint64)
    made = [many for many, _ in simhash.bucket_links(fps, np.ones(len(fps), bool))]
    assert sum(map(len, made)) < len(fps)
    classes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = brute_components(fps.tolist())
    for bucket in (1 << 16, 700):
        found = simhash.components(simhash.links(classes, len(fps), bucket)).collect()
        group = {r.node: r.root for r in found}
        group = [group.get(int(f), int(f)) for f in fps.view(np.int64)]
        assert len(set(zip(group, roots))) == len(set(group)) == len(set(roots))


def test_segments_cover_every_pair():
    rng = np.random.default_rng(2)
    for m in (2, 3, 4):
        for _ in range(300):
            flips = rng.choice(64, 4, replace=False)
            assert any(sum(first <= f < first + width for f in flips) <= radius for first, width, radius in simhash.segments(m))
    assert [simhash.choose_segments(n) for n in (0, 10**5, 10**9, 10**13)] == [4, 4, 3, 2]


# --- collocations


def brute_phrases(rows, top=2000):
    f, n = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    held = {g: c for g, c in f.items() if c >= 30}
    parts = lambda g: (g[i : i + k] for k in range(2, len(g)) for i in range(len(g) - k + 1))
    drop = {(lang, p) for (lang, g), c in held.items() for p in parts(g) if 100 * c >= 80 * held[lang, p]}
    by, out = collections.defaultdict(list), []
    for (lang, g), a in held.items():
        if len(g) > 1 and (lang, g) not in drop:
            s, _, l, r = min((2_000_000 * a // (held[lang, g[:k]] + held[lang, g[k:]]), k, held[lang, g[:k]], held[lang, g[k:]]) for k in range(1, len(g)))  # noqa: E741
            by[lang].append((-s, -a, " ".join(g).encode(), l, r))
    for lang, found in by.items():
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]  # noqa: E741
    return collections.Counter(out)


@pytest.fixture(scope="module")
def repeated(table_of):
    """Phrases at the count of 30, overlaps, ties of score and count, capitals, words that hold odd letters."""
    rows = [(i, "a a a a. Red\tfox ran; red fox sat! x\x0by", "en", "s") for i in range(29)]
    rows += [(30, "A a a, red FOX", None, "s"), (31, "red fox" + " red fox" * 40, "und", "s"), (32, "é.É é ß" * 40, "fr", "s")]
    rows += [(i, "one two three four five", "de", "s") for i in range(31)] + [(40, "one two. four five " * 3, "de", "s"), (41, "p q. r s. " * 33, "de", "s")]
    return table_of(rows).repartition(4), [(*r, 0) for r in rows]


@pytest.mark.parametrize("kind", ("odd", "small", "empty", "repeated"))
@pytest.mark.parametrize("shard,part,top", [(1 << 21, 1 << 22, 2000), (300, 1000, 3)])
def test_collocations(tables, repeated, kind, shard, part, top, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "PART", part)
    docs, rows = repeated if kind == "repeated" else tables[kind]
    got = collections.Counter(tuple(r) for r in phrases.collocations(docs, top).collect())
    assert got == brute_phrases(rows, top)
    assert got or kind != "repeated"


def test_texts_of_a_shard_are_a_row_per_length_and_part():
    ids = np.array([0, *[1, 2, 3, 4] * 50, 0], np.int32)
    shard = phrases.Shard("en", b"a\nb\nc\nd", ids.tobytes(), 4)
    two = shard.left(shard.unigrams())
    every = [shard.unigrams(), two, *shard.longer(two)]
    batches = list(phrases._texts(2)(0, shard, np.sort(np.concatenate([shard.keys(g) for g in every]))))
    assert sum(b.num_rows for b in batches) <= 4 * 2 < sum(len(g.count) for g in every)
    got = {p: n for b in batches for ps, ns in zip(b.column("phrases").to_pylist(), b.column("counts").to_pylist()) for p, n in zip(ps, ns)}
    assert got == {p: n for g in every for p, n in zip(shard.phrases(g), g.count.tolist())}


def test_only_words_that_were_told_are_extended(monkeypatch):
    ids = np.array([0, *[1, 2, 3] * 40, 0, *range(4, 104), 0], np.int32)
    shard = phrases.Shard("en", b"\n".join(b"w%d" % i for i in range(1, 104)), ids.tobytes(), 4)
    one, two = shard.unigrams(), shard.left(shard.unigrams())
    told = np.sort(np.concatenate([shard.keys(g.where(g.count >= 30)) for g in (one, two)]))
    asked, extend = [], phrases.FMIndex.extend

    def counted(self, low, high, other):
        asked.append(int((high - low).sum()))
        return extend(self, low, high, other)

    monkeypatch.setattr(phrases.FMIndex, "extend", counted)
    list(phrases._long(1)(0, shard, told))
    assert asked[0] == 120  # of 220 words
    found = phrases._bigrams(shard, told)
    assert {tuple(w): c for w, c in zip(found.words.tolist(), found.count.tolist())} == {(1, 2): 40, (2, 3): 40, (3, 1): 39}


def test_order_of_codes_that_do_not_fit_with_their_places():
    code = np.random.default_rng(3).integers(0, 50, 999)
    for kinds in (50, 1 << 62):
        order, ordered = phrases._ordered(code, kinds)
        assert sorted(order.tolist()) == list(range(999)) and (code[order] == ordered).all() and (np.diff(ordered) >= 0).all()


@pytest.mark.parametrize("shard,text", [(1 << 21, 1 << 22), (7, 1 << 22), (7, 10), (1, 1)])
def test_shards_hold_every_word_between_marks(shard, text, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "TEXT", text)
    rows = [("en", "A b\tB. c"), ("fr", ""), ("en", "one two three four five six seven eight nine ten"), ("de", " \t "), ("en", "..!"), ("fr", "\u00c9t\u00e9 x\x0by\xa0z,q"), ("en", "a b")]
    batches = [pa.record_batch({"lang": [r[0] for r in part], "text": [r[1] for r in part]}) for part in (rows[:4], rows[4:])]
    got = collections.defaultdict(list)
    for b in phrases._shards(iter(batches)):
        for r in b.to_pylist():
            words, ids = ["|", *r["vocabulary"].decode().split("\n")], np.frombuffer(r["ids"], np.int32).tolist()
            assert ids[0] == ids[-1] == 0 and len(set(words)) == len(words) and r["words"] == sum(map(bool, ids))
            got[r["lang"]] += "\0".join(words[i] for i in ids).split("|")
    pieces = lambda ps: sorted("\0".join(p.split("\0")).strip("\0") for p in ps if p.strip("\0"))
    assert pieces(got["en"]) == sorted(["a\0b\0b", "c", "\0".join("one two three four five six seven eight nine ten".split()), "a\0b"])
    assert pieces(got["fr"]) == sorted(["\u00c9t\u00e9\0x", "y\xa0z", "q"]) and pieces(got["de"]) == []


def words_shard(n, kinds, depth):
    """A shard of random words and what it is told, if all its words and bigrams are frequent."""
    ids = np.concatenate([[0], np.random.default_rng(8).integers(1, kinds + 1, n), [0]]).astype(np.int32)
    ids[::20] = 0
    shard = phrases.Shard("en", b"\n".join(b"word%d" % i for i in range(1, kinds + 1)), ids.tobytes(), depth)
    one = shard.unigrams()
    return ids, shard, np.sort(np.concatenate([shard.keys(one), shard.keys(shard.left(one))]))


@pytest.mark.parametrize("work,most", [("_short", 100), ("_long", 100), ("_texts", 150)])
def test_memory_of_a_shard_at_work(work, most):
    """Bytes for a word, besides the shard's own: what is found leaves at once, and extensions come in blocks."""
    n = 1 << 21
    _, shard, told = words_shard(n, 1 << 14, 2 if work == "_short" else 4)
    tracemalloc.start()
    held = pa.total_allocated_bytes()
    peak = 0
    for b in getattr(phrases, work)(50)(0, shard, told):
        peak = max(peak, pa.total_allocated_bytes() - held)
    peak += tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak / n < most


@pytest.mark.parametrize("block,gather", [(1 << 18, 1 << 20), (40, 300), (1, 1)])
def test_blocks_of_a_shard_find_the_same(block, gather, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "GATHER", gather)
    monkeypatch.setattr(phrases, "BATCH", gather)
    ids, shard, told = words_shard(1500, 12, 4)
    pieces = [p.tolist() for p in np.split(ids[ids > 0], np.cumsum(np.diff(np.flatnonzero(ids == 0)) - 1))]
    count = collections.Counter(" ".join(f"word{w}" for w in p[i : i + k]) for p in pieces for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
    three = [k for g in shard.longer(phrases._bigrams(shard, told)) for k in shard.keys(g).tolist()]
    for work, keys, lengths in ((phrases._short(7), told, (1, 2)), (phrases._long(7), told, (3, 4))):
        got = collections.Counter()
        for b in work(0, shard, keys):
            for k, c in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                got.update(dict(zip(np.frombuffer(k, np.uint64).tolist(), np.frombuffer(c, np.uint32).tolist())))
        assert sorted(got.values()) == sorted(c for p, c in count.items() if len(p.split()) in lengths)
    got = collections.Counter()
    for b in phrases._texts(7)(0, shard, np.sort(np.concatenate([told, np.array(three, np.uint64)]))):
        assert set(b.column("lang").to_pylist()) == {"en"}
        for ps, cs in zip(b.column("phrases").to_pylist(), b.column("counts").to_pylist()):
            got.update(dict(zip(ps, cs)))
    assert got == count


def test_rows_of_a_part_are_summed_as_they_come(monkeypatch):
    """A task that gets several parts, and each from many shards, holds no more than a batch of texts, and one part's keys."""
    parts, shards, n = 4, 30, 20_000
    monkeypatch.setattr(phrases, "GATHER", n, raising=False)
    rng = np.random.default_rng(9)
    words, keys = [f"a phrase of text {i}" for i in range(n)], np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
    lists = lambda x, kind: pa.array([x], pa.list_(kind))

    def texts(p):
        return pa.record_batch({"part": [p], "lang": ["en"], "phrases": lists(words, pa.string()), "counts": lists([1] * n, pa.int64())})

    def packed(p, s):
        return pa.record_batch({"part": [p], "shard": [s], "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([np.ones(n, np.uint32).tobytes()], pa.binary())})

    for work, make, most in ((phrases._sum_texts, lambda p, s: texts(p), 8 * texts(0).nbytes), (phrases._sum_part, packed, 2 * shards * 8 * n)):
        before, held, out = pa.total_allocated_bytes(), [], []

        def batches():
            for p in range(parts):
                for s in range(shards):
                    held.append(pa.total_allocated_bytes() - before)
                    yield make(p, s)

        for b in work(batches()):
            out.append(b.num_rows)
            del b
        assert sum(out) == (parts * n if work is phrases._sum_texts else parts * shards) and max(held) < most


def test_batches_that_spark_sends_are_small(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH", 1 << 16)
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "CAST(repeat('x', 4096) AS BINARY) AS x")
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with phrases._small_batches(spark):
        assert max(r.n for r in sizes.collect()) < 1 << 18
    assert spark.conf.get(name) == before and max(r.n for r in sizes.collect()) > 1 << 20


def test_staged_rounds_leave_no_shuffle_files(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    rows = spark.range(0, 1000).repartition(3, "id")
    held = tracker.shuffleStatuses().size()
    with phrases._small_batches(spark):
        rows.write.parquet(f"{tmp_path}/out")
    assert tracker.shuffleStatuses().size() <= held and spark.conf.get(name) == before
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000


def test_shards_of_many_languages_close_before_they_are_full(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 100)
    taken, given = [], []

    def batches():
        for i in range(60):
            taken.append(i)
            yield pa.record_batch({"lang": [f"l{i % 20}"], "text": ["a b c d e f g h i"]})

    for b in phrases._shards(batches()):
        given.append((len(taken), b.to_pylist()[0]["words"]))
    assert sum(w for _, w in given) == 60 * 9
    assert all(9 * k - sum(w for t, w in given if t <= k) <= 200 for k in range(1, 60))


def test_intervals_of_both_indexes():
    rng = np.random.default_rng(6)
    pieces = [rng.integers(1, 6, rng.integers(1, 9)) for _ in range(200)]
    ids = np.concatenate([[0], *(x for p in pieces for x in (p, [0]))]).astype(np.int32)
    shard = phrases.Shard("en", b"a\nb\nc\nd\ne", ids.tobytes(), 4)
    count = collections.Counter(tuple(p[i : i + k].tolist()) for p in pieces for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
    two = shard.left(shard.unigrams())
    for g in (shard.unigrams(), two, *shard.longer(two)):
        assert {tuple(w): c for w, c in zip(g.words.tolist(), g.count.tolist())} == {w: c for w, c in count.items() if len(w) == g.words.shape[1]}
    other = shard.right(shard.unigrams())
    order, back = np.lexsort(two.words.T), np.lexsort(other.words.T)
    for name in ("words", "count", "ahead", "back"):
        assert (getattr(two, name)[order] == getattr(other, name)[back]).all()


# --- Merkle manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    fields = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def brute_proofs(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[lang] = brute_levels([brute_leaf(r) for r in by[lang]])
    top = brute_levels([trees[x][-1][0] for x in langs]) if langs else []
    for t, lang in enumerate(langs):
        for i, r in enumerate(by[lang]):
            folded, siblings = brute_leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)), ""
            for levels, at in ((trees[lang], i), (top, t)):
                for level in levels[:-1]:
                    run = level[at // 2 * 2 : at // 2 * 2 + 2]
                    siblings += "".join(run[: at % 2] + run[at % 2 + 1 :])
                    run[at % 2] = folded
                    folded, at = digest("".join(run)), at // 2
            yield r[0], brute_leaf(r), trees[lang][-1][0], top[-1][0], digest(siblings), folded, folded == top[-1][0]


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(i, f"t{i}" if i % 5 else None, [None, "", "en", "fr", "zz"][min(i % 9, 4)], "s" if i % 4 else None, i if i % 3 else None) for i in range(157)]
    rows += [(5, "x", "en", "s", 1)] * 40 + [(None, None, None, None, None)] * 3 + [(None, "q", "yy", None, 2**63 - 1), (7, "é", "yy", "", 0), (21, "", "z", "s", 2**63 - 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), rows


@pytest.mark.parametrize("kind", ("odd", "small", "empty", "fields"))
@pytest.mark.parametrize("part,tile", [(3000, 10), (7, 2), (1, 1)])
def test_manifest_proofs(tables, fields, kind, part, tile):
    docs, rows = fields if kind == "fields" else tables[kind]
    leaves, nodes, n_trees, root = merkle.manifest(docs, part, tile)
    want = collections.Counter(brute_proofs(rows))
    assert collections.Counter(tuple(r) for r in merkle.prove(leaves, nodes, n_trees, root or b"").collect()) == want
    some = leaves.where("idx % 3 = 1")
    got = collections.Counter(tuple(r) for r in merkle.prove(some, nodes, n_trees, root or b"").collect())
    assert not got - want and got.total() == some.count()


def test_multiproofs_are_minimal():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 64, 100):
        held = rng.choice(n, rng.integers(1, n + 1), replace=False)
        asked = set(merkle.missing(n, held))
        assert len(asked) == len(merkle.missing(n, held))
        siblings, derived = set(), set()
        for h in held.tolist():
            for level in range(merkle.height(n)):
                derived.add((level, h >> level))
                if (h >> level) ^ 1 < merkle.count_at(n, level):
                    siblings.add((level, (h >> level) ^ 1))
        assert asked == siblings - derived
    assert len(merkle.missing(1 << 20, np.arange(5, 3005))) < 20


def test_a_changed_row_is_noticed(fields):
    docs, rows = fields
    leaves, nodes, n_trees, root = merkle.manifest(docs, 10, 3)
    changed = leaves.withColumn("digest", merkle.F.expr("CASE WHEN doc_id = 11 THEN unhex(sha2('other', 256)) ELSE digest END")).drop("changed").selectExpr("*", "CAST(NULL AS binary) AS changed")
    got = merkle.prove(changed.where("doc_id = 11"), nodes, n_trees, root).collect()
    assert [r.verified for r in got] == [False]
    assert all(r.verified for r in merkle.prove(changed.where("doc_id = 12"), nodes, n_trees, root).collect())
