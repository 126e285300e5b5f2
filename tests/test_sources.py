"""Readers and writers on temporary folders, workflows, and the operators on a stream."""

import hashlib
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellweave import session
from cellweave.constants import DEMO_BOX
from cellweave.operators import availability, catalog, clip, convert, crop, search
from cellweave.plans import workflows
from cellweave.schemas import GRID_CELLS
from cellweave.sources import boundaries, files, sinks
from cellweave.streaming import cells as stream


@pytest.fixture
def cells(spark):
    rows = [("f1", v, f"2001-{m:02d}-10", 20.0 + 2 * i, 240.0 + 3 * i, 273.15 + i + m)
            for v in ("tas", "pr") for m in (1, 2, 12) for i in range(12)]
    df = spark.createDataFrame(rows, "file_id string, variable string, t string, lat double, lon double, value double")
    return df.select("file_id", "variable", F.col("t").cast("timestamp_ntz").alias("time"), "lat", "lon", "value")


def test_scan_and_bodies(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, body in (("x.nc", b"12345"), ("a/y.nc", b"1"), ("a/b/z.nc", b"123"), ("a/b/n.txt", b"1")):
        (tmp_path / name).write_bytes(body)
    got = {(r["name"], r["length"]) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {("x.nc", 5), ("y.nc", 1), ("z.nc", 3)}
    plan = files.scan_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert {r["name"]: bytes(r["content"]) for r in files.read_bodies(spark, str(tmp_path), "*.nc").collect()}["x.nc"] == b"12345"


def test_manifest_as_lines_and_as_array(spark, tmp_path):
    rows = [{"title": "a", "url": "u", "size_bytes": 3}, {"title": "b"}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    a = files.read_manifest(spark, str(tmp_path / "array.json"), multi_line=True).collect()
    b = files.read_manifest(spark, str(tmp_path / "lines.json")).collect()
    assert a == b and [r["size_bytes"] for r in a] == [3, None]


def test_search_pages(spark, tmp_path):
    for n, ids in enumerate((["i1", "i2"], ["i3"], [])):
        page = {"response": {"numFound": 3, "start": n, "docs": [{"instance_id": i, "url": ["u"]} for i in ids]}}
        (tmp_path / f"page{n}.json").write_text(json.dumps(page, indent=1))
    docs = files.read_search_pages(spark, str(tmp_path), multi_line=True)
    assert sorted(r["instance_id"] for r in docs.collect()) == ["i1", "i2", "i3"]


def test_granules(spark, tmp_path):
    props = [{"url": "https://x/y/g1.h5", "fileName": "named.h5", "bytes": 7}, {"url": "https://x/y/g2.h5"}, {"fileName": "lost.h5"}]
    page = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p} for p in props]}
    (tmp_path / "g.json").write_text(json.dumps(page, indent=1))
    got = {(r["title"], r["size_bytes"]) for r in files.read_granules(spark, str(tmp_path), multi_line=True).collect()}
    assert got == {("named.h5", 7), ("g2.h5", 0)}


def test_vocab_files(spark, tmp_path):
    (tmp_path / "cmip6_source_id.json").write_text(json.dumps(["A", "B"], indent=2))
    (tmp_path / "cmip5_model.json").write_text("not json")
    got = [tuple(r) for r in files.read_vocab(spark, str(tmp_path)).orderBy("term").collect()]
    assert got == [("cmip6", "source_id", "A"), ("cmip6", "source_id", "B")]


def test_geojson_lines(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": square}} for n in "ab"]
    (tmp_path / "regions.json").write_text("\n".join(map(json.dumps, features)))
    edges = boundaries.read_geojson_regions(spark, str(tmp_path / "regions.json"))
    assert edges.groupBy("region_id").count().orderBy("region_id").collect() == [("a", 4), ("b", 4)]


def test_cells_round_trip_prunes_partitions_and_pushes_the_box(spark, cells, tmp_path):
    path = str(tmp_path / "cells")
    sinks.write_cells(cells, path)
    read = files.read_cells(spark, path)
    assert read.select(cells.columns).exceptAll(cells).count() == 0 and read.count() == cells.count()
    df = workflows.crop_convert_aggregate(read, DEMO_BOX, "tas", "C")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variable" in plan
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "lat" in pushed and "lon" in pushed
    assert plan.count("Exchange") == 1
    want = [i for i in range(12) if 25 <= 20 + 2 * i <= 50 and -125 <= 240 + 3 * i - 360 <= -65]
    assert df.count() == 3 * len(want)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_cells(cells, path)


def test_catalog_and_manifest_sinks(spark, tmp_path):
    attrs = {"activity_id": "A", "source_id": "S", "variant_label": "r", "variable_id": "tas"}
    df = spark.createDataFrame(
        [("d/tas_1.nc", "tas_1.nc", attrs, None), ("e/CMIP6_tas_1.nc", "CMIP6_tas_1.nc", attrs, None)],
        "file_id string, name string, attrs map<string,string>, error string",
    )
    path = sinks.write_catalog(workflows.build_catalog(df), str(tmp_path), demo=True)
    assert path.endswith("cmip6_catalog.json")
    entry = spark.read.json(path).first()
    assert (entry["variable_id"], entry["file_count"], entry["file_id"]) == ("tas", 1, "d/tas_1.nc")
    assert "institution_id" in entry and entry["institution_id"] is None
    copies = sinks.write_duplicates(catalog.duplicates(df), str(tmp_path))
    assert [r["file_id"] for r in spark.read.json(copies).collect()] == ["e/CMIP6_tas_1.nc"]
    assert sinks.write_duplicates(catalog.duplicates(df.limit(1)), str(tmp_path / "none")) is None
    outcome = spark.createDataFrame([("a", True), ("b", False)], "title string, ok boolean")
    failed = sinks.write_failures(outcome, str(tmp_path), "prism")
    assert [r["title"] for r in files.read_manifest(spark, failed).collect()] == ["b"]
    assert sinks.write_query_results(outcome, str(tmp_path), "cmip5").endswith("cmip5_query_results_to_download.json")


class _Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class _Session:
    """Just what the folder rule reads of a session; the real setting is fixed at start."""

    def __init__(self, folder=None, **conf):
        self.sparkContext = type("Context", (), {"getCheckpointDir": lambda self: folder})()
        self.conf = _Conf(conf)


def test_scratch_folder_rule(spark):
    assert session.scratch_dir(_Session("file:/c", **{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    assert session.scratch_dir(_Session("hdfs://x/z")) == "hdfs://x/z"
    with pytest.raises(ValueError):
        session.scratch_dir(_Session())


def test_stage_lives_in_the_scratch_folder(spark):
    staged = session.stage(spark.range(5), "numbers")
    assert staged.count() == 5 and all(session.scratch_dir(spark) in f for f in staged.inputFiles())


def test_stream_equals_batch(spark, cells, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    cells.write.parquet(source)
    edges = spark.createDataFrame(
        [("R", 1, 0, i, *e) for i, e in enumerate([(-130.0, 20.5, -80.0, 20.5), (-80.0, 20.5, -100.0, 45.0), (-100.0, 45.0, -130.0, 20.5)])],
        "region_id string, polygon_id long, ring_id int, seg int, x1 double, y1 double, x2 double, y2 double",
    )
    mask = clip.region_mask(cells, edges)

    def steps(df):
        return clip.clip_filter(convert.convert_cells(crop.crop(df, DEMO_BOX), "tas", "C"), mask)

    query = stream.write_cells_stream(steps(stream.read_cells_stream(spark, source)), out, state)
    assert query.awaitTermination(120)
    got = spark.read.schema(GRID_CELLS).parquet(out).select(cells.columns)
    want = steps(cells)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_digests_of_bodies_read_in_blocks(spark, tmp_path):
    bodies = {"a.nc": b"x" * 10_007, "b.nc": b"", "c.nc": bytes(range(256)) * 64, "d.nc": b"locked"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    listed = files.body_digests(spark, str(tmp_path), "*.nc", block=64)
    lost = spark.read.format("binaryFile").load(str(tmp_path / "d.nc")).count()
    got = {r["name"]: r for r in listed.collect()}
    for name in ("a.nc", "c.nc", "d.nc"):
        assert (got[name]["md5"], got[name]["sha256"], got[name]["error"]) == (hashlib.md5(bodies[name]).hexdigest(), hashlib.sha256(bodies[name]).hexdigest(), None)
    assert lost == 1
    expected = spark.createDataFrame([("a.nc", got["a.nc"]["md5"], "MD5"), ("c.nc", "0", None), ("d.nc", None, None), ("e.nc", "1", None)], "name string, checksum string, checksum_type string")
    assert {r["name"]: r["ok"] for r in availability.verify_digests(expected, listed, "name").collect()} == {"a.nc": True, "c.nc": False, "d.nc": True, "e.nc": False}


def test_an_unreadable_body_is_a_row(spark, tmp_path):
    for name in ("a.nc", "b.nc"):
        (tmp_path / name).write_bytes(b"body")
    listed = files.body_digests(spark, str(tmp_path), "*.nc")
    rows = listed.collect()
    assert len(rows) == 2
    (tmp_path / "b.nc").unlink()
    (tmp_path / "b.nc").mkdir()  # there when listed, no file when read
    got = {r["name"]: r for r in listed.collect()}
    assert got["a.nc"]["error"] is None
    assert "b.nc" not in got or got["b.nc"]["error"] is not None


def test_search_gaps(spark):
    def page(start, held, found):
        return json.dumps({"response": {"numFound": found, "start": start, "docs": [{}] * held}})

    rows = [("n", "whole", page(0, 10, 25)), ("n", "whole", page(10, 10, 25)), ("n", "whole", page(20, 5, 25)), ("n", "none", page(0, 0, 0)),
            ("n", "lost", page(20, 10, 45)), ("n", "lost", page(0, 10, 45)), ("n", "lost", page(25, 10, 45)), ("n", "lost", page(25, 10, 45)),
            ("m", "lost", page(0, 3, 10)), ("m", "odd", "not json")]
    pages = spark.createDataFrame(rows, "node string, query string, page string")
    got = sorted(tuple(r) for r in search.search_gaps(pages).collect())
    assert got == [("m", "lost", "missing", 3, 9), ("n", "lost", "missing", 10, 19), ("n", "lost", "missing", 35, 44),
                   ("n", "lost", "repeated", 25, 29), ("n", "lost", "repeated", 25, 34)]
    status = {(r["node"], r["query"]): (r["found"], r["missing"], r["repeated"], r["complete"]) for r in search.search_status(pages).collect()}
    assert status == {("n", "whole"): (25, 0, 0, True), ("n", "none"): (0, 0, 0, True), ("n", "lost"): (45, 20, 15, False), ("m", "lost"): (10, 7, 0, False), ("m", "odd"): (0, 0, 0, True)}


def test_pages_of_a_search_are_parsed_once(spark):
    page = lambda docs: '{"response": {"numFound": 9, "start": 2, "docs": %s}}' % docs
    texts = [page('[{}, {"a": [1, 2]}, null]'), page("[]"), page("null"), page('{"a": 1}'), page("[{}"), '{"response": {"numFound": 4}}', None]
    pages = spark.createDataFrame([(str(i), "q", t) for i, t in enumerate(texts)], "node string, query string, page string")
    got = sorted((r["node"], r["start"], r["found"], r["until"]) for r in search.page_spans(pages).collect())
    assert got == [("0", 2, 9, 5), ("1", 2, 9, 2), ("2", 2, 9, 2), ("3", 2, 9, 2), ("4", 0, 0, 0), ("5", 0, 4, 0), ("6", 0, 0, 0)]
    for query in (search.search_gaps, search.search_status):
        assert "from_json" not in query(pages)._jdf.queryExecution().executedPlan().toString()


def test_the_point_scan_of_a_clip_is_pruned(spark, cells, tmp_path):
    path = str(tmp_path / "cells")
    sinks.write_cells(cells, path)
    read = files.read_cells(spark, path)
    square = [[(-115.0, 23.0), (-100.0, 23.0), (-100.0, 33.0), (-115.0, 33.0)]]
    rows = [("R", 0, 0, i, *square[0][i], *square[0][(i + 1) % 4]) for i in range(4)]
    edges = spark.createDataFrame(rows, "region_id string, polygon_id long, ring_id int, seg int, x1 double, y1 double, x2 double, y2 double")
    for buffer_km in (0.0, 100.0):
        box = clip.grown_extent(edges, buffer_km)
        pushed = clip.points_in_reach(read, box)._jdf.queryExecution().executedPlan().toString()
        pushed = pushed[pushed.index("PushedFilters") :].split("ReadSchema")[0]
        assert "GreaterThanOrEqual(lat" in pushed and "(lon" in pushed
        mask = clip.region_mask(read, edges, buffer_km)
        everything = clip.covered_points(clip.grid_points(read), edges, buffer_km)
        assert sorted(map(tuple, mask.collect())) == sorted(map(tuple, everything.collect())) != []
        plan = clip.clip_filter(read, mask)._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(lat" in plan and "GreaterThanOrEqual(lon" in plan
        assert clip.clip_filter(read, mask).count() == 6 * mask.count()
    nothing = clip.region_mask(read, edges.limit(0))
    assert nothing.count() == 0 and clip.clip_filter(read, nothing).count() == 0


def test_grid_sink_is_laid_out_for_crops(spark, tmp_path):
    cells = spark.range(40_000).selectExpr(
        "'f' || id % 2 AS file_id", "'tas' AS variable", "timestamp_ntz '2000-01-01' + make_interval(0, id % 24) AS time",
        "CAST(id * 7919 % 180 - 90 AS double) AS lat", "CAST(id * 104729 % 360 AS double) AS lon", "CAST(id AS double) AS value",
    )
    names = spark.createDataFrame([("f0", "tas_1.nc", "run/a"), ("f1", "tas_2.nc", None)], "file_id string, name string, rel_dir string")
    path = str(tmp_path / "grids")
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    sinks.write_grids(cells, names, path, "cropped")
    for k, v in before.items():
        spark.conf.set(k, v)
    one = sinks.read_grid(spark, path, "run/a/tas_1_cropped.nc")
    assert one.select(cells.columns).exceptAll(cells.where("file_id = 'f0'")).count() == 0 and one.count() == 20_000
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(output" in plan
    met = total = 0
    for file in tmp_path.glob("grids/*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.schema.column(c).name: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            total += 1
            met += stats["lat"].min <= 40 and stats["lat"].max >= 30 and stats["lon"].min <= 20 and stats["lon"].max >= 10
    assert total >= 50 and met <= total / 5
    flat = str(tmp_path / "flat")
    sinks.write_grids(cells, names, flat, "clipped", keep_dirs=False)
    assert sorted(r[0] for r in spark.read.parquet(flat).select("output").distinct().collect()) == ["tas_1_clipped.nc", "tas_2_clipped.nc"]


def test_counts_come_from_the_write(spark, tmp_path):
    attrs = {"activity_id": "A", "source_id": "S", "variant_label": "r", "variable_id": "tas"}
    rows = [("d/tas_1.nc", "tas_1.nc", attrs, None), ("e/CMIP6_tas_1.nc", "CMIP6_tas_1.nc", attrs, None), ("f/tas_1.nc", "tas_1.nc", attrs, None),
            ("g/pr_1.nc", "pr_1.nc", {}, None), ("h/pr_2.nc", "pr_2.nc", attrs, "Read error"), ("i/pr_3.nc", "pr_3.nc", attrs, None)]
    df = spark.createDataFrame(rows, "file_id string, name string, attrs map<string,string>, error string")
    counts = catalog.write_catalog_counted(df, str(tmp_path / "catalog"))
    assert counts == {"included": 2, "skipped": 2, "duplicate": 2}
    assert {r["file_id"] for r in spark.read.parquet(str(tmp_path / "catalog")).collect()} == {"d/tas_1.nc", "i/pr_3.nc"}
    assert catalog.write_catalog_counted(df.limit(0), str(tmp_path / "none")) == {"included": 0, "skipped": 0, "duplicate": 0}
