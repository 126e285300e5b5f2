"""Operators against brute force and literal cases."""

import json
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import Row as gridding_row, functions as F

from cellweave.constants import DEMO_BOX
from cellweave.functions.reducers import REDUCERS
from cellweave.functions import calendar
from cellweave.operators import aggregate, availability, axes, catalog, clip, convert, crop, dissolve, expand, gridding, search
from cellweave.schemas import GRID_VARS, SEARCH_DOC
from cellweave.session import stage
from cellweave.sources import boundaries

NAN = float("nan")


# --- clip --------------------------------------------------------------------------------------


def edges_of(spark, polygons):
    """``polygons``: lists of rings, each a list of integer positions."""
    rows = []
    for n, rings in enumerate(polygons):
        for r, ring in enumerate(rings):
            for i, (x, y) in enumerate(ring):
                x2, y2 = ring[(i + 1) % len(ring)]
                rows.append(("R", n, r, i, float(x), float(y), float(x2), float(y2)))
    return spark.createDataFrame(
        rows, "region_id string, polygon_id long, ring_id int, seg int, x1 double, y1 double, x2 double, y2 double"
    )


def inside(spark, polygons, points):
    df = spark.createDataFrame([(float(y), float(x)) for x, y in points], "lat double, lon double").distinct()
    got = clip.inside_points(df, edges_of(spark, polygons)).collect()
    return {(r["lon"], r["lat"]) for r in got}


def strictly_in(rings, x, y):
    """Even-odd rule in exact arithmetic, borders excluded."""
    odd = False
    for ring in rings:
        for i, (ax, ay) in enumerate(ring):
            bx, by = ring[(i + 1) % len(ring)]
            cross = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
            if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and x < Fraction((bx - ax) * (y - ay), by - ay) + ax:
                odd = not odd
    return odd


SQUARE = [[(0, 0), (4, 0), (4, 4), (0, 4)]]
GRID = [(x, y) for x in range(-1, 11) for y in range(-1, 11)]


def test_square_excludes_its_border(spark):
    assert inside(spark, [SQUARE], GRID) == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)}


def test_shared_borders_dissolve(spark):
    """Four squares around (4, 4): the inner borders and their meeting point are interior."""
    squares = [[[(a, b), (a + 4, b), (a + 4, b + 4), (a, b + 4)]] for a in (0, 4) for b in (0, 4)]
    assert inside(spark, squares, GRID) == {(x, y) for x in range(1, 8) for y in range(1, 8)}


def test_three_squares_leave_the_corner_out(spark):
    squares = [[[(a, b), (a + 4, b), (a + 4, b + 4), (a, b + 4)]] for a, b in ((0, 0), (4, 0), (0, 4))]
    got = inside(spark, squares, GRID)
    assert (4, 4) not in got and (4, 2) in got and (2, 4) in got and (5, 5) not in got


def test_hole_and_its_vertices_are_outside(spark):
    ring = [(0, 0), (8, 0), (8, 8), (0, 8)]
    hole = [(4, 2), (6, 4), (4, 6), (2, 4)]
    polygon = [ring, hole]
    assert inside(spark, [polygon], GRID) == {p for p in GRID if strictly_in(polygon, *p)}


def test_hole_filled_by_another_polygon(spark):
    ring, hole = [(0, 0), (8, 0), (8, 8), (0, 8)], [(2, 2), (6, 2), (6, 6), (2, 6)]
    assert inside(spark, [[ring, hole], [hole]], GRID) == {(x, y) for x in range(1, 8) for y in range(1, 8)}


def test_random_triangles_match_brute_force(spark):
    rng = random.Random(7)
    triangles = [[[(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(3)]] for _ in range(12)]
    points = [(x, y) for x in range(-20, 21) for y in range(-20, 21)]
    want = {p for p in points if any(strictly_in(t, *p) for t in triangles)}
    got = inside(spark, triangles, points)
    # Points that lie on a border of every triangle touching them may be interior to the union.
    on_border = lambda p: not any(strictly_in(t, *p) for t in triangles)
    assert want <= got
    assert all(on_border(p) for p in got - want)
    eps = Fraction(1, 1000)
    for x, y in got - want:
        around = [(x + dx * eps, y + dy * eps) for dx, dy in ((1, 2), (-1, 2), (1, -2), (-1, -2), (2, 1), (-2, -1))]
        assert all(any(strictly_in(t, *q) for t in triangles) for q in around)


def test_many_points_of_one_latitude_cross_blocks(spark):
    polygons = [[[(a, 0), (a + 3, 0), (a + 3, 2), (a, 2)]] for a in range(-170, 170, 7)]
    xs = [Fraction(k, 4) for k in range(-700, 700)]
    df = spark.createDataFrame([(1.0, float(x)) for x in xs], "lat double, lon double")
    got = {r["lon"] for r in clip.inside_points(df, edges_of(spark, polygons)).collect()}
    assert got == {float(x) for x in xs if any(p[0][0][0] < x < p[0][1][0] for p in polygons)}


def test_buffer_reaches_over_tiles(spark):
    points = [(x / 10, y / 10) for x in range(-30, 31, 3) for y in range(-30, 31, 3)]
    df = spark.createDataFrame([(y, x) for x, y in points], "lat double, lon double")
    edges = edges_of(spark, [[[(-1, -1), (1, -1), (1, 1), (-1, 1)]], [[(-170, 60), (170, 61), (0, 65)]]])
    got = {(r["lat"], r["lon"]) for r in clip.near_points(df, edges, 70.0, tile_km=20.0).collect()}

    def metres(lon, lat):
        e2 = 2 / 298.257223563 - 1 / 298.257223563**2
        e, s = math.sqrt(e2), math.sin(math.radians(lat))
        k0 = math.cos(math.radians(30)) / math.sqrt(1 - e2 * 0.25)
        q = (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
        return 6378137.0 * k0 * math.radians(lon), 6378137.0 * q / (2 * k0)

    def distance(p, a, b):
        (px, py), (ax, ay), (bx, by) = metres(*p), metres(*a), metres(*b)
        t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)
        t = min(1.0, max(0.0, t))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    segments = [((r["x1"], r["y1"]), (r["x2"], r["y2"])) for r in edges.collect()]
    want = {(y, x) for x, y in points if min(distance((x, y), a, b) for a, b in segments) <= 70_000}
    assert got == want and 0 < len(want) < len(points)


def test_mask_values_and_statuses(spark):
    rows = [("f", "tas", 1.0, 361.0, 5.0, -9.0), ("f", "tas", 9.0, 1.0, 5.0, -9.0), ("f", "pr", 9.0, 1.0, 5.0, None),
            ("f", "scalar", None, None, 7.0, -9.0)]
    cells = spark.createDataFrame(
        rows, "file_id string, variable string, lat double, lon double, value double, fill_value double"
    )
    mask = clip.region_mask(cells, edges_of(spark, [SQUARE]))
    out = {(r["variable"], r["lat"]): r["value"] for r in clip.clip_mask(cells, mask).collect()}
    assert out[("tas", 1.0)] == 5.0 and out[("tas", 9.0)] == -9.0 and out[("scalar", None)] == 7.0
    assert math.isnan(out[("pr", 9.0)])
    assert [r["lat"] for r in clip.clip_filter(cells, mask).collect()] == [1.0]


def test_wkt_and_geojson_agree(spark):
    wkt = "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1)), ((-7.5 1e1, 8 10, 8 12, -7.5 1e1)))"
    geometry = {
        "type": "MultiPolygon",
        "coordinates": [[[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]],
                        [[[-7.5, 10], [8, 10], [8, 12], [-7.5, 10]]]],
    }
    df = spark.createDataFrame([("R", 1, wkt, json.dumps(geometry))], "region_id string, polygon_id long, w string, g string")
    a = boundaries.boundary_edges(df, boundaries.wkt_polygons(F.col("w"))).collect()
    b = boundaries.boundary_edges(df, boundaries.geojson_polygons(F.col("g"))).collect()
    assert sorted(a) == sorted(b) and len(a) == 10


# --- crop, axes, conversion --------------------------------------------------------------------


def test_crop_literal_case(spark):
    rows = [("f", 35.0, 250.0), ("f", 36.0, 251.0), ("f", 29.0, 250.0), ("f", 35.0, 261.0), ("f", None, 250.0), ("f", None, None)]
    cells = spark.createDataFrame(rows, "file_id string, lat double, lon double")
    box = {"min_lat": 30, "max_lat": 40, "min_lon": -110, "max_lon": -100}
    assert crop.crop(cells, box).count() == 4
    assert crop.crop_inside(cells, box).count() == 2


def test_crop_filter_reaches_parquet(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(100).selectExpr("double(id) / 2 as lat", "double(id) * 3 as lon", "double(1) as value").write.parquet(path)
    plan = crop.crop_inside(spark.read.parquet(path), DEMO_BOX)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(lat,25.0)" in pushed and "lon" in pushed.split("ReadSchema")[0]


def test_axis_rules(spark):
    rows = [
        ("a", 0, "lat", {"standard_name": "latitude"}), ("a", 1, "lon", {"standard_name": "longitude"}),
        ("b", 0, "lat", {"standard_name": "grid_latitude"}), ("b", 1, "Latitude", {}), ("b", 2, "LON", {}),
        ("c", 0, "t", {}), ("c", 1, "time", {}), ("c", 2, "z", {"axis": "T"}),
        ("d", 0, "datetime", {}), ("d", 1, "t", {}),
        ("e", 0, "x", {}),
    ]
    gv = spark.createDataFrame(rows, "file_id string, var_pos int, var_name string, attrs map<string,string>")
    got = {r["file_id"]: (r["lat_var"], r["lon_var"]) for r in axes.resolve_for_crop(gv).collect()}
    assert got["a"] == ("lat", "lon") and got["b"] == ("Latitude", "LON") and got["e"] == (None, None)
    got = {r["file_id"]: (r["lat_var"], r["lon_var"]) for r in axes.resolve_for_clip(gv).collect()}
    assert got["b"] == ("lat", None)
    got = {r["file_id"]: r["time_var"] for r in axes.resolve_time(gv).collect()}
    assert got["c"] == "z" and got["d"] == "t" and got["e"] is None


@pytest.mark.parametrize(
    "variable, unit, value, want",
    [("tas", "C", 273.15, 0.0), ("tas", "C", 373.15, 100.0), ("pr", "mm/day", 0.5, 43200.0), ("sfcWind", "km/h", 10.0, 36.0)],
)
def test_conversions(spark, variable, unit, value, want):
    cells = spark.createDataFrame([(variable, value), ("other", 10.0)], "variable string, value double")
    out = {r["variable"]: r["value"] for r in convert.convert_cells(cells, variable, unit).collect()}
    assert out[variable] == pytest.approx(want) and out["other"] == 10.0
    every = {r["variable"]: r["value"] for r in convert.convert_all(cells).collect()}
    assert every == pytest.approx(out)


def test_conversion_guards(spark):
    cells = spark.createDataFrame([("tas", 1.0, "m/s"), ("tas", 274.15, " K ")], "variable string, value double, units string")
    out = [tuple(r) for r in convert.convert_cells(cells, "tas", "C").select("value", "units").collect()]
    assert out == [(1.0, "m/s"), (1.0, "C")]
    with pytest.raises(ValueError):
        convert.convert_cells(cells, "tasmax", "C")
    every = convert.convert_all(cells)
    assert every.columns.count("units") == 1
    assert [tuple(r) for r in every.select("value", "units").collect()] == [(1.0, "m/s"), (pytest.approx(1.0), "C")]
    rules = spark.createDataFrame([("tas", "C", "K", 1.0, -273.15), ("tas", "F", "K", 1.8, -459.67)],
                                  "variable string, target_unit string, source_unit string, scale double, offset double")
    out = convert.convert_lookup(cells, rules, "F").collect()
    assert [(r["value"], r["units"]) for r in out] == [(1.0, "m/s"), (pytest.approx(33.8), "F")]
    gv = spark.createDataFrame([("a", 0, "tas", "K"), ("b", 0, "tas", "m/s"), ("c", 0, "pr", "K")],
                               "file_id string, var_pos int, var_name string, units string")
    files = gv.select("file_id")
    got = {r["file_id"]: r["message"] for r in convert.convert_status(files, gv, "tas", "C").collect()}
    assert got == {"a": "ok", "b": "Unit mismatch: Expected K, found m/s", "c": "Variable 'tas' not found"}
    assert convert.convert_status(files, gv, "zg", "C").where("ok").count() == 0


# --- aggregation -------------------------------------------------------------------------------

SAMPLES = {"numbers": [3.0, 1.0, 2.0, 7.0], "mixed": [1.0, NAN, None, 4.0], "nan": [NAN, NAN], "masked": [None, None], "both": [None, NAN]}


@pytest.mark.parametrize("method", sorted(REDUCERS))
def test_reducers_follow_numpy(spark, method):
    rows = [(k, x) for k, xs in SAMPLES.items() for x in xs]
    df = spark.createDataFrame(rows, "k string, value double")
    got = {r["k"]: r["value"] for r in df.groupBy("k").agg(REDUCERS[method](F.col("value")).alias("value")).collect()}
    assert got["masked"] is None
    for k in ("numbers", "mixed", "nan", "both"):
        xs = np.array([x for x in SAMPLES[k] if x is not None])
        with np.errstate(all="ignore"):
            want = getattr(np, f"nan{method}")(xs) if not np.all(np.isnan(xs)) else {"sum": 0.0, "prod": 1.0}.get(method, NAN)
        assert got[k] == pytest.approx(float(want), nan_ok=True), k


def test_monthly_literal_case(spark):
    rows = [("f", "tas", "2000-01-01", 273.15), ("f", "tas", "2000-01-15", 274.15), ("f", "tas", "2000-02-01", 275.15)]
    cells = spark.createDataFrame(rows, "file_id string, variable string, t string, value double").select(
        "file_id", "variable", F.col("t").cast("timestamp_ntz").alias("time"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), "value"
    )
    out = aggregate.aggregate(cells, "monthly", "mean", "tas", with_stamp=True).orderBy("period").collect()
    assert [(r["period"], r["value"], str(r["stamp"])) for r in out] == [
        ("2000-01", pytest.approx(273.65), "2000-01-15"), ("2000-02", pytest.approx(275.15), "2000-02-15"),
    ]
    with pytest.raises(ValueError):
        aggregate.aggregate(cells, "monthly", "mode")


@pytest.mark.parametrize("small", [2, 500, 100_000])
def test_median_of_groups_of_any_size(spark, small):
    """One group far larger than the rest, 10,000 distinct values, fill values far apart, infinities, ties and NULL keys."""
    rng = random.Random(3)
    groups = {"hot": [rng.choice([1.0, 2.5, rng.gauss(0, 1e6)]) for _ in range(3000)], None: [rng.random() for _ in range(81)],
              "tie": [5.0] * 60, "few": [1.0, NAN, 4.0], "nan": [NAN], "masked": [None], "neg": [-1e300, 1e300, -2.0, 0.0],
              "fill": [1e-30, 1e20, 9.97e36] * 400 + [280 + rng.random() for _ in range(5001)], "two": [-0.0, 1e-320, 5e-324, 1e-310],
              "many": [rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(10_000)] + [NAN, None] * 40,
              "inf": [math.inf] * 4 + [-math.inf, 1.0, 2.0], "even": [1.0, 2.0] * 700, "near": [1 + k * 2**-52 for k in range(4001)]}
    df = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k string, value double").repartition(5)
    out = aggregate.group_median(df, ["k"], small)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["value"] for r in out.collect()}
    assert set(got) == set(groups)
    assert got["masked"] is None and math.isnan(got["nan"])
    for k in set(groups) - {"masked", "nan"}:
        assert got[k] == pytest.approx(np.nanmedian([x for x in groups[k] if x is not None]), rel=1e-15), k


RAW_HEADERS = [
    ("a", 0, "lat", ["lat"], None, {}), ("a", 1, "lon", ["lon"], None, {}), ("a", 2, "time", ["time"], None, {"calendar": "360_day"}),
    ("a", 3, "plev", ["plev"], None, {}), ("a", 4, "ta", ["time", "plev", "lat", "lon"], -9.0, {}), ("a", 5, "area", ["lon", "lat"], None, {}),
    ("a", 6, "height", [], None, {}), ("a", 7, "ens", ["member", "time"], None, {}),
    ("b", 0, "Lat", ["y"], None, {}), ("b", 1, "x", ["x"], None, {"standard_name": "longitude"}), ("b", 2, "ta", ["y", "x"], None, {}),
    ("c", 0, "lat", ["lat"], None, {}), ("c", 1, "ta", ["lat"], None, {}),
    ("d", 0, "lat", ["j", "i"], None, {}), ("d", 1, "lon", ["j", "i"], None, {}), ("d", 2, "ta", ["j", "i"], None, {}),
]
RAW_VALUES = [
    ("a", "lat", [0], 10.0), ("a", "lat", [1], 20.0), ("a", "lon", [0], 350.0), ("a", "time", [0], 59.0), ("a", "time", [1], 60.0),
    ("a", "plev", [0], 850.0), ("a", "ta", [1, 0, 1, 0], 7.0), ("a", "ta", [0, 0, 0, 0], -9.0), ("a", "ta", [0, 0, 5, 0], 1.0),
    ("a", "area", [0, 1], 3.0), ("a", "height", [], 2.0), ("a", "ens", [4, 1], 6.0),
    ("b", "Lat", [0], 1.0), ("b", "x", [0], 2.0), ("b", "ta", [0, 0], 5.0), ("c", "lat", [0], 1.0), ("c", "ta", [0], 5.0), ("d", "ta", [0, 0], 5.0),
]


@pytest.fixture(scope="module")
def raw(spark):
    headers = [(f, k, n, "double", d, fill, "days since 2000-01-01" if n == "time" else "1", attrs) for f, k, n, d, fill, attrs in RAW_HEADERS]
    return spark.createDataFrame(headers, GRID_VARS), spark.createDataFrame(RAW_VALUES, "file_id string, var_name string, pos array<int>, value double")


def test_cells_from_axes(raw):
    got = sorted(map(repr, (tuple(r) for r in gridding.cells_from_axes(*raw).drop("seconds").collect())))
    level = lambda *xs: [gridding_row(dim=d, value=v) for d, v in xs]
    want = [
        ("a", "ta", 2000, 3, 1, 20.0, 350.0, level(("plev", 850.0)), 7.0), ("a", "ta", 2000, 2, 30, 10.0, 350.0, level(("plev", 850.0)), None),
        ("a", "ta", 2000, 2, 30, None, 350.0, level(("plev", 850.0)), 1.0), ("a", "area", None, None, None, 20.0, 350.0, [], 3.0),
        ("a", "height", None, None, None, None, None, [], 2.0), ("a", "ens", 2000, 3, 1, None, None, level(("member", 4.0)), 6.0),
        ("b", "ta", None, None, None, 1.0, 2.0, [], 5.0),
    ]
    assert got == sorted(map(repr, want))
    clipped = gridding.cells_from_axes(*raw, variable="ta", rule="clip").collect()
    assert sorted((r["file_id"], r["value"]) for r in clipped if r["value"]) == [("a", 1.0), ("a", 7.0)]
    status = {rule: {r["file_id"]: r["message"] for r in gridding.axes_status(raw[0], rule).collect()} for rule in gridding.RULES}
    flat, none = gridding.NOT_FLAT, "No coordinates found"
    assert status == {"crop": {"a": "ok", "b": "ok", "c": "Missing coordinate variables", "d": flat}, "clip": {"a": "ok", "b": none, "c": none, "d": flat}}


@pytest.mark.parametrize("short,broadcast", [(0, 500_000), (1, 500_000), (0, 0)])
def test_long_axes_give_the_same_cells(raw, short, broadcast, monkeypatch):
    want = sorted(map(repr, gridding.cells_from_axes(*raw).collect()))
    monkeypatch.setattr(gridding, "SHORT", short)
    monkeypatch.setattr(gridding, "BROADCAST_STEPS", broadcast)
    assert sorted(map(repr, gridding.cells_from_axes(*raw).collect())) == want


def test_a_long_axis_is_not_copied_with_every_element(spark):
    headers = [("a", k, n, "double", d, None, "1", {}) for k, (n, d) in enumerate([("lat", ["lat"]), ("lon", ["lon"]), ("ta", ["lat", "lon"])])]
    values = [("a", "lat", [i], i / 4) for i in range(200)] + [("a", "lon", [0], 5.0)] + [("a", "ta", [i, 0], float(i)) for i in range(200)]
    cells = gridding.cells_from_axes(spark.createDataFrame(headers, GRID_VARS), spark.createDataFrame(values, "file_id string, var_name string, pos array<int>, value double"))
    assert cells._jdf.queryExecution().executedPlan().toString().count("Join") == 2  # the variables, and the latitudes
    assert sorted((r["value"], r["lat"], r["lon"]) for r in cells.collect()) == [(float(i), i / 4, 5.0) for i in range(200)]


def test_cells_from_axes_feed_crop_and_aggregate(raw):
    cells = crop.crop(gridding.cells_from_axes(*raw), {"min_lat": 15, "max_lat": 30, "min_lon": -20, "max_lon": 0})
    out = aggregate.aggregate(cells, "monthly", "max").collect()
    assert sorted((r["variable"], r["period"], r["lat"], r["value"]) for r in out if r["lat"]) == [("ta", "2000-03", 20.0, 7.0)]
    plan = gridding.cells_from_axes(*raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "SortMergeJoin" not in plan


def test_aggregated_files_keep_their_axis_and_report_failures(raw):
    headers, values = raw
    times = gridding.time_axes(headers, values)
    rows, status = aggregate.aggregate_files(gridding.cells_from_axes(headers, values), headers, times, "ta", "monthly", "max")
    got = sorted((r["period"], r["time_value"], r["lat"], r["aggregation_details"]) for r in rows.collect() if r["lat"])
    details = "Method: max, Frequency: monthly"
    assert got == [("2000-02", 44.0, 10.0, details), ("2000-03", 74.0, 20.0, details)]
    lost = "Required time or variable 'ta' not found"
    assert {r["file_id"]: (r["ok"], r["message"]) for r in status.collect()} == {"a": (True, "ok"), "b": (False, lost), "c": (False, lost), "d": (False, lost)}
    for freq, method, message in (("weekly", "max", "Unsupported frequency 'weekly'"), ("annual", "mode", "Unsupported method 'mode'")):
        rows, status = aggregate.aggregate_files(gridding.cells_from_axes(headers, values), headers, times, "ta", freq, method)
        assert rows.count() == 0 and status.where("file_id = 'a'").first()["message"] == message


@pytest.mark.parametrize("calendar,freq,period,want", [
    ("julian", "annual", "2000", 181.0 + 1), ("noleap", "annual", "2001", 365 + 181.0), ("360_day", "seasonal", "1999-S1", -360 + 44.0),
    ("standard", "seasonal", "2000-S4", 319.0), ("standard", "monthly", "12000-02", None), ("all_leap", "monthly", "-001-02", None), ("odd", "annual", "2000", None),
])
def test_period_axis(spark, calendar, freq, period, want):
    df = spark.createDataFrame([(period, "days since 2000-01-01", calendar)], "period string, units string, calendar string")
    got = aggregate.period_axis(df, freq).first()["time_value"]
    assert (got == want) if want is not None or calendar == "odd" else got is not None


def test_levels_stay_apart(spark):
    rows = [("f", "ta", "2000-01-01", lev, lev / 2) for lev in (850.0, 500.0)] * 2
    cells = spark.createDataFrame(rows, "file_id string, variable string, t string, lev double, value double").select(
        "file_id", "variable", F.col("t").cast("timestamp_ntz").alias("time"), "lev", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), "value"
    )
    for method in ("mean", "median"):
        out = aggregate.aggregate(cells, "monthly", method)
        assert sorted((r["lev"], r["value"]) for r in out.collect()) == [(500.0, 250.0), (850.0, 425.0)]


def test_years_of_five_digits_stay_whole(spark):
    df = spark.createDataFrame([(12345, 3), (7, 11), (-5, 1)], "y int, m int")
    got = [r[0] for r in df.select(calendar.period_key_ymd(F.col("y"), F.col("m"), "monthly")).collect()]
    assert got == ["12345-03", "0007-11", "-0005-01"]


# --- dissolved regions -------------------------------------------------------------------------


def outline(spark, polygons, load=256):
    return sorted(tuple(r) for r in dissolve.dissolved_edges(edges_of(spark, polygons), load).collect())


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


@pytest.mark.parametrize("load", [256, 2])
def test_dissolved_borders(spark, load):
    shared = outline(spark, [[box(0, 0, 2, 2)], [box(2, 0, 4, 2)]], load)
    assert (2, 0, 2, 2) not in shared and len(shared) == 6
    partly = outline(spark, [[box(0, 0, 2, 4)], [box(2, 1, 4, 3)]], load)  # ends on the other's side
    assert (2, 1, 2, 3) not in partly and {(2, 0, 2, 1), (2, 3, 2, 4)} <= set(partly) and len(partly) == 8
    assert outline(spark, [[box(0, 0, 9, 9)], [box(2, 2, 4, 4)]], load) == outline(spark, [[box(0, 0, 9, 9)]], load)
    assert outline(spark, [[box(0, 0, 3, 3)]] * 2, load) == outline(spark, [[box(0, 0, 3, 3)]], load)
    ring = outline(spark, [[box(0, 0, 9, 9), box(2, 2, 6, 6)], [box(2, 2, 4, 6)]], load)  # a hole half filled
    assert (4, 2, 4, 6) in ring and (2, 2, 2, 6) not in ring and (4, 2, 6, 2) in ring and (2, 2, 4, 2) not in ring
    crossed = outline(spark, [[[(0, 0), (4, 0), (2, 4)]], [[(0, 2), (4, 2), (2, -2)]]], load)
    assert len(crossed) == 6 * 2 and (1, 2, 3, 2) not in crossed and (0, 2, 1, 2) in crossed
    assert outline(spark, [], load) == []


@pytest.mark.parametrize("seed", [1])
def test_points_in_the_dissolved_region(spark, seed):
    """Inside the outline is inside any polygon; on shared borders too, on the outline not."""
    rng = random.Random(seed)
    polygons = []
    for _ in range(14):
        x, y, w, h = rng.randrange(12), rng.randrange(12), rng.randrange(1, 6), rng.randrange(1, 6)
        polygons.append([box(x, y, x + w, y + h) if rng.random() < 0.6 else [(x, y), (x + 2 * w, y), (x + w, y + h)]])
    points = [(x / 2, y / 2) for x in range(-2, 48) for y in range(-2, 40)]
    df = spark.createDataFrame([(float(y), float(x)) for x, y in points], "lat double, lon double")
    whole = dissolve.dissolve(edges_of(spark, polygons), load=8)
    got = {tuple(r) for r in clip.inside_points(df, whole).collect()}
    assert got == {tuple(r) for r in clip.inside_points(df, edges_of(spark, polygons)).collect()}


@pytest.mark.parametrize("height", [0.01, 0.7, 5.0])
def test_band_heights_do_not_change_what_is_inside(spark, height):
    shapes = [[box(0, 0, 9, 9), box(2, 2, 6, 6)], [[(1, 1), (9, 3), (4, 12)]], [box(-3, 8, 2, 10)]]
    points = spark.createDataFrame([(y / 4, x / 4) for x in range(-16, 44) for y in range(-4, 52)], "lat double, lon double")
    edges = edges_of(spark, shapes)
    assert set(clip.inside_points(points, edges, height).collect()) == set(clip.inside_points(points, edges).collect())


def test_rings_of_a_dissolved_region(spark):
    stairs = [[box(i, i, i + 2, i + 2)] for i in range(12)]  # one long ring
    got = dissolve.dissolve(edges_of(spark, [*stairs, [box(100, 0, 103, 3), box(101, 1, 102, 2)]])).collect()
    rings = [sorted(r["seg"] for r in got if r["ring_id"] == ring) for ring in {r["ring_id"] for r in got}]
    assert sorted(map(len, rings)) == [4, 4, sum(r["x1"] < 90 for r in got)]
    assert all(ring == list(range(len(ring))) for ring in rings)


def test_a_crowded_tile_is_split(spark):
    """A thousand short edges in one place, a few long ones elsewhere: no leaf holds much more than the load."""
    rows = [(k / 1000, 0.0, (k + 1) / 1000, 0.001) for k in range(1000)] + [(10.0 * k, 5.0, 10.0 * k + 9, 6.0) for k in range(100)]
    boxes = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")
    sizes = [r["count"] for r in dissolve.quadtree(boxes, 20).groupBy("level", "tile_x", "tile_y").count().collect()]
    assert max(sizes) <= 24 and len(sizes) > 50


# --- catalog, search, manifests ----------------------------------------------------------------


def files_df(spark, rows):
    return spark.createDataFrame(rows, "file_id string, name string, attrs map<string,string>, error string")


def attrs(**kw):
    base = dict(activity_id="A", source_id="S", variant_label="r1", variable_id="tas", institution_id="I")
    return {k: v for k, v in {**base, **kw}.items() if v is not None}


def test_dedup_prefers_plain_names(spark):
    df = files_df(spark, [("a/ScenarioMIP_250km_tas_file.nc", "ScenarioMIP_250km_tas_file.nc", {}, None),
                          ("b/tas_file.nc", "tas_file.nc", {}, None), ("c/CMIP6_tas_file.nc", "CMIP6_tas_file.nc", {}, None),
                          ("d/CMIP6_zg.nc", "CMIP6_zg.nc", {}, None), ("e/zg.nc", "zg.nc", {}, None)])
    assert {r["file_id"] for r in catalog.deduplicate(df).collect()} == {"b/tas_file.nc", "d/CMIP6_zg.nc"}
    assert {r["file_id"] for r in catalog.duplicates(df).collect()} == {
        "a/ScenarioMIP_250km_tas_file.nc", "c/CMIP6_tas_file.nc", "e/zg.nc"}


def test_catalog_has_one_layout_for_every_key(spark):
    rows = [(f"p{i:04d}", f"f{i}.nc", attrs(variable_id=("tas", "pr")[i % 3 == 0], institution_id=None if i == 0 else "I"), None)
            for i in range(500)]
    rows += [("q1", "q1.nc", attrs(variant_label=""), None), ("q2", "q2.nc", attrs(activity_id=None, source_id=None), None),
             ("q3", "q3.nc", attrs(), "broken"), ("r", "r.nc", attrs(source_id="T"), None)]
    a = catalog.file_attributes(files_df(spark, rows))
    whole = catalog.catalog_entries(a).collect()
    assert {r["catalog_key"] for r in whole} == {"A:S:r1", "A:T:r1"}
    big = [r for r in whole if r["catalog_key"] == "A:S:r1"]
    assert {r["institution_id"] for r in big} == {None}
    assert sorted(r["file_id"] for r in big if r["variable_id"] == "tas") == [f"p{i:04d}" for i in range(500) if i % 3]
    assert {(r["variable_id"], r["file_count"]) for r in big} == {("tas", 333), ("pr", 167)}
    flat = {(r["catalog_key"], r["variable_id"]): r for r in catalog.catalog_flat(a).collect()}
    assert flat["A:S:r1", "pr"]["file_count"] == 167 and flat["A:S:r1", "pr"]["institution_id"] is None
    skipped = {r["file_id"]: r["reason"] for r in catalog.skipped(a).collect()}
    assert skipped == {
        "q1": "Incomplete metadata (missing: variant_label)", "q2": "Incomplete metadata (missing: activity_id, source_id)",
        "q3": "Failed to read or extract metadata: broken"}
    assert {r["status"]: r["files"] for r in catalog.summary(files_df(spark, rows)).collect()} == {
        "included": 501, "skipped": 3, "duplicate": 0}


def docs_df(spark, rows):
    return spark.createDataFrame(rows, "arrival int, instance_id string, data_node string, url array<string>")


def test_merge_keeps_single_lists_and_unites_repeats(spark):
    rows = [(1, "X.1", "CEDA", ["n1/z", "n1/a"]), (2, "X.1", "DKRZ", ["n2/b", "n1/z"]), (3, "X.2", "CEDA", ["n2/z", "n2/a"]),
            (4, None, "CEDA", ["n3"]), (5, "", "CEDA", ["n3"]), (6, "X.3", "CEDA", None), (7, "X.3", "CEDA", [])]
    df = docs_df(spark, rows)
    got = {r["instance_id"]: r for r in search.merge_nodes(df, "instance_id").collect()}
    assert {k: (r["seen"], r["data_node"]) for k, r in got.items()} == {"X.1": (2, "DKRZ"), "X.2": (1, "CEDA"), "X.3": (2, "CEDA")}
    urls = [tuple(r) for r in search.merged_urls(df, "instance_id").orderBy("instance_id", "pos", "url").collect()]
    assert urls == [("X.1", 0, "n1/a"), ("X.1", 0, "n1/z"), ("X.1", 0, "n2/b"), ("X.2", 0, "n2/z"), ("X.2", 1, "n2/a")]


def test_a_hot_id_is_ranked_whole(spark):
    """One id with most addresses: places run from 1 over all of it, though it lies in several ranges."""
    url = lambda i: f"https://{('a', 'llnl', 'ceda')[i % 3]}.org/{i:04d}|x|HTTPServer"
    rows = [(i, "hot", "CEDA", [url(i % 700), url(i % 3)]) for i in range(2000)]
    rows += [(5000 + i, f"id{i:02d}", "LLNL", [url(i), url(0)]) for i in range(20)]
    df = docs_df(spark, rows)
    records = {r["instance_id"]: r for r in search.merge_nodes(df, "instance_id").collect()}
    assert records["hot"]["seen"] == 2000 and records["hot"]["arrival"] == 0 and len(records) == 21
    ranked = search.rank_addresses(search.merged_urls(df, "instance_id"), "instance_id", "llnl, ceda").collect()
    hot = sorted((r["place"], r["rank"], r["mirror"]) for r in ranked if r["instance_id"] == "hot")
    want = sorted(range(700), key=lambda i: ((3, 0, 1)[i % 3], url(i)))
    assert hot == [(k + 1, (3, 0, 1)[i % 3], url(i).split("|")[0]) for k, i in enumerate(want)]
    assert sorted(r["place"] for r in ranked if r["instance_id"] == "id05") == [1, 2]


def test_mirrors_by_preference(spark):
    urls = ["https://b.org/1|x|HTTPServer", "https://a.dkrz.de/2|x|HTTPServer", "https://c.org/3|x|OPENDAP",
            "https://d.llnl.gov/4|x|HTTPServer", "bad|HTTPServer", "https://e.org/5|x|HTTPServer"]
    df = docs_df(spark, [(1, "X", "CEDA", urls)])
    out = search.mirror_rank(df, "llnl, dkrz").orderBy("place").collect()
    assert [(r["rank"], r["mirror"][-1]) for r in out] == [(0, "4"), (1, "2"), (3, "1"), (3, "5")]
    assert [r["mirror"][-1] for r in search.http_mirrors(df).orderBy("pos").collect()] == ["1", "2", "4", "5"]


def test_facets_and_flags(spark):
    rows = [("a", "a.nc", "DKRZ", False, True, 1, None, None, None, {"variable_id": ["tas", "pr"]}),
            ("b", "b.nc", "CEDA", True, False, 1, None, None, None, {"variable_id": ["pr"], "frequency": ["day"]}),
            ("c", "c.nc", "CEDA", None, True, 1, None, None, None, {})]
    df = spark.createDataFrame(rows, SEARCH_DOC)
    ids = lambda d: sorted(r["instance_id"] for r in d.collect())
    assert ids(search.facet_search(df, {"variable_id": "pr"})) == ["a", "b"]
    assert ids(search.facet_search(df, {"variable_id": "pr", "frequency": "day", "source_id": ""})) == ["b"]
    assert ids(search.facet_search(df, {})) == ["a", "b", "c"]
    assert ids(search.facet_flags(df)) == ["a", "c"]
    assert ids(search.facet_flags(df, replica=True, latest=True, data_node="CEDA")) == ["c"]
    assert [r["data_node"] for r in search.node_priority(df).collect()] == ["DKRZ", "CEDA"]


def test_checksums(spark):
    right = "8d777f385d3dfec8815d20f7496026dc"
    rows = [("a", right, "MD5"), ("b", "0" * 64, "sha256"), ("c", None, None), ("d", right, "md5"), ("e", right, None)]
    manifest = spark.createDataFrame(rows, "title string, checksum string, checksum_type string")
    bodies = spark.createDataFrame([(t, bytearray(b"data")) for t in "abce"], "title string, content binary")
    got = {r["title"]: r["ok"] for r in availability.verify_checksums(manifest, bodies, "title").collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False}


# --- expected files ----------------------------------------------------------------------------


def test_era5_cases(spark):
    rows = [(1, "t2m", "2021-01-15", "2021-02-01"), (2, "Precip (total)", "2021-01-01", "2021-01-31"), (3, "nope", "2021-01-01", "2021-12-31"),
            (4, "sst", "2021-03-05", "2021-02-01")]
    requests = spark.createDataFrame(rows, "request_id int, variable string, s string, e string").select(
        "request_id", "variable", F.to_date("s").alias("start"), F.to_date("e").alias("end"))
    out = expand.era5_expand(requests).collect()
    assert sorted((r["request_id"], r["part"], r["month"]) for r in out) == [(1, 0, 1), (1, 0, 2), (2, 0, 1), (2, 1, 1)]
    assert {r["prefix"] for r in out if r["request_id"] == 1} == {
        "e5.oper.an.sfc/202101/e5.oper.an.sfc.128_167_2t.", "e5.oper.an.sfc/202102/e5.oper.an.sfc.128_167_2t."}
    assert [r["request_id"] for r in expand.era5_unknown(requests).collect()] == [3]
    listed = {r["code"]: r["file_code"] for r in expand.era5_listing(expand.era5_variables(spark)).collect()}
    assert listed["precip"] == "128_143_cp + 128_142_lsp" and listed["sst"] == "128_034_sstk"


def test_first_key_of_a_crowded_prefix(spark):
    p = "e5.oper.an.sfc/202101/e5.oper.an.sfc.128_167_2t."
    keys = [(p + f"{i:05d}.nc", i) for i in range(3000, 0, -1)] + [(p[:-1] + "x.1.nc", 9), ("other/key", 1)]
    expected = spark.createDataFrame([(p,), (p.replace("2t", "2d"),)], "prefix string")
    listing = spark.createDataFrame(keys, "key string, size long")
    out = availability.first_keys(expected, listing).collect()
    assert [(r["key"], r["size_bytes"], r["filename"]) for r in out] == [(p + "00001.nc", 1, (p + "00001.nc").split("/")[-1])]
    assert availability.all_keys(expected, listing).count() == 3000
    many = expected.crossJoin(spark.range(500).select(F.col("id").alias("request_id")))
    assert availability.all_keys(many, listing).count() == 3000


@pytest.mark.parametrize("tiles, box, names", [
    (expand.dem_tiles_cop30, (41.9, 40.1, -90.1, -91.9), {"N40_00_W092", "N40_00_W091", "N41_00_W092", "N41_00_W091"}),
    (expand.dem_tiles_usgs, (42.5, 41.5, -92.5, -93.5), {"n42w094", "n42w093", "n43w094", "n43w093"}),
])
def test_tiles(spark, tiles, box, names):
    df = spark.createDataFrame([(1, *box)], "box_id int, north double, south double, east double, west double")
    files = [r["filename"] for r in tiles(df).collect()]
    assert len(files) == 4 and all(any(n in f for f in files) for n in names)


def test_bounds_are_checked():
    assert expand.normalize_bounds([42.9, 41.1, -91.1, -92.9])["south"] == 41.1
    assert expand.normalize_bounds({"north": 1, "south": 1, "east": 2, "west": 2})["north"] == 1.0
    for bad in ([1, 1, 2, 2], [1, 2, 3, 4], [2, 1, 3, 4], [1, 2, 3], {"north": 1, "south": 2, "east": 0, "west": 0}, "N"):
        with pytest.raises((ValueError, KeyError)):
            expand.normalize_bounds(bad)


def test_usgs_edition(spark):
    tiles = spark.createDataFrame([("n42w093",), ("n43w093",), ("n44w093",)], "tile_id string")
    base = "StagedProducts/Elevation/13/TIFF/"
    key = lambda e, t: f"{base}{e}/{t}/USGS_13_{t}.tif"
    keys = [key("historical", "n42w093"), key("current", "n42w093"), key("historical", "n43w093"), base + "current/n44w093/other.tif"]
    listing = spark.createDataFrame([(k, 1) for k in keys], "key string, size long")
    got = {r["tile_id"]: r["key"] for r in availability.usgs_keys(tiles, listing).collect()}
    assert got == {"n42w093": key("current", "n42w093"), "n43w093": key("historical", "n43w093")}


def test_crossings_are_found_and_ordered_in_one_place(spark):
    lats = stage(spark.createDataFrame([(float(i),) for i in range(1, 9)], "lat double"), "lats")
    plan = clip._events(lats, edges_of(spark, [SQUARE]), 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and "hashpartitioning(lat" not in plan


def test_what_a_piece_passes_is_counted_in_one_place(spark):
    borders = stage(spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0), (1, 2.0, 0.0, 2.0, 2.0)], "polygon long, ax double, ay double, bx double, by double"), "borders")
    sides = dissolve._sides(borders, borders.select(*dissolve.ENDS), "x", "y")
    assert sorted((r["ax"], r["near"], r["far"]) for r in sides.collect()) == [(0.0, False, True), (2.0, True, False)]
    plan = sides._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(part" in plan and not re.search(r"hashpartitioning\([^)]*polygon", plan)
