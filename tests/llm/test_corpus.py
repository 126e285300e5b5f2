"""Operators over the whole corpus, against brute force on odd tables and on the smallest test data."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from cellweave.llm import difference_cover, exact_dedup, mixing, ngram_join, queries, sharding, suffix_dedup
from cellweave.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, table_of, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    return {"odd": (table_of(odd_rows).repartition(3), odd_rows), "small": (docs, small), "empty": (table_of([]), [])}


KINDS = ("odd", "small", "empty")


# --- exact dedup


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, (5000, 4)).astype(np.uint64)
    levels, slots = exact_dedup.mph_build(words)
    assert sorted(slots) == list(range(5000))
    back = exact_dedup._unpack(exact_dedup._pack(levels))
    assert (exact_dedup.mph_slots(back, words) == slots).all()
    other = exact_dedup.mph_slots(back, rng.integers(0, 1 << 63, (1000, 4)).astype(np.uint64))
    assert ((other >= -1) & (other < 5000)).all()


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("shard_keys", [4_000, 10])
def test_exact_dedup(tables, kind, shard_keys, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD_KEYS", shard_keys)
    docs, rows = tables[kind]
    keyed = exact_dedup.digests(docs)
    old = exact_dedup.F.coalesce(exact_dedup.F.col("doc_id") <= 70, exact_dedup.F.lit(False))
    facts = exact_dedup.dedup(keyed.where(old), keyed.where(~old), len(rows))
    got = exact_dedup.join_facts(keyed, facts, ["text_sha256"], "group_size", len(rows)).collect()
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(doc_id)
    assert len(got) == len(rows)
    for r in got:
        g = groups[r.text_sha256]
        assert r.doc_id in g and r.group_size == len(g)
        assert r.keep_id == min((x for x in g if x is not None), default=None)


def test_exact_dedup_rests_on_the_lookup(tables, monkeypatch):
    """With a lookup that finds nothing, repeats of the history are no longer counted with it."""
    docs, rows = tables["odd"]
    keyed = exact_dedup.digests(docs).where("doc_id IS NOT NULL")
    right = exact_dedup.dedup(keyed.where("doc_id <= 82"), keyed.where("doc_id > 82"), len(rows)).collect()
    monkeypatch.setattr(exact_dedup, "mph_slots", lambda levels, words: np.full(len(words), -1))
    wrong = exact_dedup.dedup(keyed.where("doc_id <= 82"), keyed.where("doc_id > 82"), len(rows)).collect()
    assert len({r.text_sha256 for r in right}) == len(right) < len(wrong)


# --- suffix dedup


def brute_repeats(rows):
    """By (doc_id, text); a null id is last, rows alike are one document."""
    last = (1 << 63) - 1
    first, out = {}, {}
    docs = sorted({(last if i is None else i, t or "") for i, t, *_ in rows})
    for d, t in docs:
        raw = t.encode()
        for p in range(len(raw) - 99):
            w = hashlib.blake2b(raw[p : p + 100], digest_size=16).digest()
            if w not in first or (d, p) < first[w]:
                first[w] = (d, p)
    for d, t in docs:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if first[hashlib.blake2b(raw[p : p + 100], digest_size=16).digest()] < (d, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out[d, t] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("kind,hot,segment", [("odd", 50_000, 1 << 20), ("odd", 1, 5000), ("small", 50_000, 1 << 20), ("small", 1, 1 << 20), ("empty", 50_000, 1 << 20)])
def test_suffix_dedup(tables, kind, hot, segment, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    docs, rows = tables[kind]
    want = brute_repeats(rows)
    got = suffix_dedup.remove_repeats(docs, hot).collect()
    expected = collections.Counter((i, *want[(1 << 63) - 1 if i is None else i, t or ""]) for i, t, *_ in rows)
    assert collections.Counter(tuple(r) for r in got) == expected


def test_many_rows_without_an_id_stay_apart(table_of):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    rows = []
    for i in range(1500):
        at = rng.randrange(3800)
        rows.append((None if i % 5 else i % 7, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60))) + base[at : at + rng.randrange(90, 200)], "en", "s"))
    want = brute_repeats(rows)
    expected = collections.Counter((i, *want[(1 << 63) - 1 if i is None else i, t]) for i, t, *_ in rows)
    assert collections.Counter(tuple(r) for r in suffix_dedup.remove_repeats(table_of(rows).repartition(4)).collect()) == expected


@pytest.mark.parametrize("bucket", [64, 1 << 17])
def test_difference_cover_sorting(bucket, monkeypatch):
    monkeypatch.setattr(difference_cover, "BUCKET", bucket)
    cover = difference_cover.difference_cover(32)
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))
    rng = np.random.default_rng(3)
    for letters in (1, 2, 3):
        base = rng.integers(97, 97 + letters, 900).astype(np.uint8)
        text = np.concatenate([base, base[:400], base])
        text[rng.integers(0, len(text), 6)] = 120
        starts = np.sort(rng.choice(len(text) - 100, 700, replace=False))
        got = difference_cover.equal_windows(text, starts, 100)
        windows = [text[s : s + 100].tobytes() for s in starts]
        assert len(set(zip(got.tolist(), windows))) == len(set(windows)) == len(set(got.tolist()))


# --- n-gram join


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute_groups(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                up[root(a)] = root(b)
    least = {}
    for n, r in enumerate(rows):
        if r[0] is not None:
            least[root(n)] = min(least.get(root(n), r[0]), r[0])
    return [(r[0], len(sets[n]), least.get(root(n)) if sets[n] else r[0]) for n, r in enumerate(rows)]


@pytest.mark.parametrize("kind,family", [("odd", 4096), ("odd", 3), ("small", 4096), ("small", 2), ("empty", 4096)])
def test_ngram_join(tables, kind, family):
    docs, rows = tables[kind]
    got = ngram_join.similar_groups(docs, family).drop("text_hash").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_groups(rows))


def test_family_join_finds_all_components():
    rng = np.random.default_rng(4)
    for trial in range(20):
        base = [np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64)) for _ in range(3)]
        sets = []
        for _ in range(60):
            s = base[rng.integers(3)].copy()
            s[rng.integers(0, len(s), rng.integers(0, 12))] = rng.integers(0, 1 << 62)
            sets.append(np.unique(s))
        up = list(range(60))
        root = lambda a: a if up[a] == a else root(up[a])
        links = ngram_join.join_family(sets)
        for a, b in links:
            assert ngram_join.similar(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))
            up[root(a)] = root(b)
        for a in range(60):
            for b in range(a):
                if ngram_join.similar(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))):
                    assert root(a) == root(b)


def test_one_of_each_group(tables):
    docs, rows = tables["odd"]
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = {(i, t) for (i, t, *_), (_, _, c) in zip(rows, brute_groups(rows)) if i == c}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 130)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- sharding


@pytest.mark.parametrize("kind", KINDS)
def test_sharding(tables, kind):
    docs, rows = tables[kind]
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len((t or "").encode()) + 1) for i, t, *_ in rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    if kind == "small":
        sizes = [sum(r.size for r in shards[k]) for k in range(16)]
        largest = max(r.size for r in got)
        assert max(sizes) - min(sizes) <= 2 * largest


def test_sharding_subdivides_a_hot_key_and_is_native(spark):
    rows = [(i, "one hot text" if i % 3 else f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(docs)
    sizes = [r.b for r in out.groupBy("shard").agg(sharding.F.sum("size").alias("b")).collect()]
    assert len(sizes) == 16 and max(sizes) < 1.05 * min(sizes)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_sharding_subdivides_a_hot_text_without_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 200)
    docs = spark.createDataFrame([(None, "one hot text")] * 3000 + [(i, f"text {i}") for i in range(900)], "doc_id long, text string").repartition(6)
    got = sharding.shard_documents(docs).collect()
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    sizes = [sum(r.size for r in rows) for rows in shards.values()]
    assert len(got) == 3900 and len(sizes) == 16 and max(sizes) < 1.05 * min(sizes)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())


def test_range_of(spark):
    cuts = [-5, 0, 3, 9, 11]
    df = spark.createDataFrame([(k,) for k in range(-8, 14)], "k long")
    for n in range(len(cuts) + 1):
        got = df.select("k", sharding.range_of(sharding.F.col("k"), cuts[:n]).alias("r")).collect()
        assert all(r.r == sum(c <= r.k for c in cuts[:n]) for r in got)


# --- mixing


def test_apportionment():
    assert mixing.sainte_lague(np.array([53.0, 24.0, 23.0]), 7).tolist() == [3, 2, 2]
    rng = np.random.default_rng(5)
    for _ in range(50):
        votes = rng.integers(0, 1000, rng.integers(1, 12)).astype(float)
        seats = int(rng.integers(0, 60))
        want = np.zeros(len(votes), int)
        if votes.sum():
            for _ in range(seats):
                want[int(np.argmax(votes / (2 * want + 1)))] += 1
        assert mixing.sainte_lague(votes, seats).tolist() == want.tolist()
    assert mixing.targets(np.array([10, 1000]), np.array([5.0, 1.0]), 900).tolist() == [20, 880]
    assert mixing.targets(np.array([0, 10]), np.array([5.0, 1.0]), 15).tolist() == [0, 15]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("cell", [20_000, 7])
def test_mixing(tables, kind, cell, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    docs, rows = tables[kind]
    got = mixing.mix_documents(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs).collect()))
    size = collections.Counter()
    for _, text, _, source in rows:
        size[source] += len(WORD.findall(text or ""))
    assert len(got) == len(rows)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = dict(zip(order, mixing.targets(np.array([size[s] for s in order]), np.array([float(weights[s]) for s in order]), 1.5 * sum(size.values())) if order else []))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    least = min((t for t in target.values() if t > 0), default=0)
    block = max(1, min(mixing.MOST_BLOCK, int(least) // mixing.LEAST_BLOCKS))
    for s in order:
        cells = -(-sum(r[3] == s for r in rows) // cell)
        assert abs(taken[s] - target[s]) <= block * (2 + 2 * cells)


def test_many_tiny_sources_get_their_targets(table_of):
    rows = [(i, "one two three four five six seven eight nine ten", "en", f"s{i:02d}") for i in range(60)] + [(100, "word " * 4000, "en", "z")]
    for part in (rows[:60], rows):
        got = mixing.mix_documents(table_of(part)).collect()
        for r in got:
            assert abs(r.taken - r.target) <= max(0.1 * r.target, 1) and r.taken <= 2 * r.size
    assert sum(r.taken for r in mixing.mix_documents(table_of(rows[:60])).collect()) == 900


def test_a_selection_takes_its_blocks_evenly(table_of):
    rows = [(i, "w " * (i % 7 + 1), "en", "s") for i in range(3000)] + [(9000, "w " * 50_000, "en", "t"), (9001, "w", "en", "u")]
    got = mixing.mix_documents(table_of(rows)).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - t) <= 2 + 0.02 * t for s, t in target.items())


def test_rows_without_an_id_ship_their_own_text_only(table_of):
    """Near copies without ids: a text goes to the places of its own class, not to those of all."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        rows.append((None, " ".join(words), "en", "s"))
    docs = table_of(rows)
    facts, sketch = ngram_join.document_facts(docs)
    got = ngram_join.similar_groups(docs).collect()
    assert len(got) == 60 and {r.component_id for r in got} == {None}
    counts = np.zeros(1 << ngram_join.COUNT_BITS, np.int64)
    for r in sketch.collect():
        counts[r["bucket"]] = r["n"]
    classes = facts.where("n > 0").groupBy("h1", "h2").agg(ngram_join.F.min("doc_id").alias("rep"), ngram_join.F.min("text_hash").alias("rep_hash"), ngram_join.F.first("n").alias("n"))
    member = ngram_join.families(ngram_join.prefix_tokens(docs, counts), classes)
    found = ngram_join.links(docs, classes, member)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rep_hash" in plan and found.count() >= 59  # the texts are met by their hash as well


# --- the pipeline


def test_pipeline(spark, tables):
    docs, rows = tables["small"]
    now, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < 4:
            assert out.columns == docs.columns
            now = spark.createDataFrame(out.collect(), docs.schema)
            seen.append([(r.doc_id, r.text, r.lang, r.source) for r in now.collect()])
        else:
            assert out.count() == len(seen[-1])
    texts = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert len(seen[0]) >= 0.99 * len(texts) and set(seen[0]) <= set(texts)
    assert {r[0] for r in seen[1]} == {i for i, _, c in brute_groups(seen[0]) if i == c}
    from cellweave.llm import decontaminate

    bench = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {seen[1][n][0] for n, *_ in decontaminate.Matcher(bench).find([decontaminate.normal(r[1]) for r in seen[1]])}
    assert {r[0] for r in seen[2]} == {r[0] for r in seen[1]} - leaks
    assert set(seen[3]) <= set(seen[2]) and max(collections.Counter(seen[3]).values()) == 2
    assert corpus_pipeline.run(spark, SF).count() == len(seen[3])


def test_pipeline_on_odd_and_empty_tables(spark, tables):
    for kind in ("odd", "empty"):
        now = tables[kind][0]
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            rows, schema = out.collect(), out.schema
            now = spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("key", list(queries.SQL))
def test_queries_match_sql(spark, key):
    from checks.compare import _rows, connect

    con = connect(SF)
    df = queries.QUERIES[key](spark, SF)
    cur = con.execute(queries.SQL[key])
    assert _rows(df.columns, df.collect()) == _rows([d[0] for d in cur.description], cur.fetchall())


def test_queries_run(spark):
    for name, query in queries.QUERIES.items():
        table = "pages" if name.startswith("op3") else "documents"
        n = query(spark, SF).count()
        if name.startswith("op12"):
            assert n > 0  # phrases, not documents
        elif not name.startswith("op4"):
            assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
