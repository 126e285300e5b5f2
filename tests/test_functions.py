"""Scalar functions on literal cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cellweave.functions import calendar as cal
from cellweave.functions import coords, naming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("lon, want", [(251.0, -109.0), (180.0, 180.0), (180.5, -179.5), (-30.0, -30.0), (0.0, 0.0)])
def test_normalize_lon(spark, lon, want):
    assert one(spark, coords.normalize_lon(F.lit(lon))) == want


def test_lon_in_box_is_exact_at_the_edge(spark):
    box = {"min_lat": 30, "max_lat": 40, "min_lon": -110, "max_lon": -100}
    rows = spark.createDataFrame([(250.0,), (249.999,), (260.0,), (260.001,), (-110.0,), (-99.0,)], "lon double")
    kept = [r["lon"] for r in rows.where(coords.lon_in_box(F.col("lon"), box)).collect()]
    assert kept == [250.0, 260.0, -110.0]


def test_equal_area_constants(spark):
    assert one(spark, coords.equal_area_x(F.lit(180.0))) == pytest.approx(17367530.445, abs=1e-3)
    assert one(spark, coords.equal_area_y(F.lit(90.0))) == pytest.approx(7342230.136, abs=1e-2)


def test_segment_distance(spark):
    args = [F.lit(float(v)) for v in (0, 5, 3, 0, 3, 2)]
    assert one(spark, coords.segment_distance(*args)) == pytest.approx(math.hypot(3, 3))
    args = [F.lit(float(v)) for v in (0, 1, 3, 1, 3, 1)]
    assert one(spark, coords.segment_distance(*args)) == 3.0


@pytest.mark.parametrize(
    "day, keys",
    [
        ("2000-01-15", ("2000-01", "2000", "1999-S1")),
        ("2000-02-29", ("2000-02", "2000", "1999-S1")),
        ("2000-03-01", ("2000-03", "2000", "2000-S2")),
        ("2000-12-31", ("2000-12", "2000", "2000-S1")),
        ("2000-09-10", ("2000-09", "2000", "2000-S4")),
    ],
)
def test_period_keys(spark, day, keys):
    t = F.lit(day).cast("date")
    got = tuple(one(spark, cal.period_key(t, f)) for f in ("monthly", "annual", "seasonal"))
    assert got == keys


def test_period_stamps(spark):
    assert one(spark, cal.period_stamp(F.lit("2000-02"), "monthly")) == dt.date(2000, 2, 15)
    assert one(spark, cal.period_stamp(F.lit("2000"), "annual")) == dt.date(2000, 7, 1)
    assert one(spark, cal.period_stamp(F.lit("1999-S1"), "seasonal")) == dt.date(1999, 2, 15)
    assert one(spark, cal.period_stamp(F.lit("1999-S4"), "seasonal")) == dt.date(1999, 11, 15)


def test_unknown_frequency_is_refused():
    with pytest.raises(ValueError):
        cal.period_key_ymd(F.lit(2000), F.lit(1), "weekly")


def test_month_chain_stays_clamped(spark):
    start, end = F.lit("2024-01-31").cast("date"), F.lit("2024-05-01").cast("date")
    assert one(spark, cal.month_chain(start, end)) == [
        dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 29), dt.date(2024, 4, 29),
    ]
    assert one(spark, cal.month_chain(end, start)) == []


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024-01-05", "2024-01-05T00:00:00Z"),
        ("2024-01-05 10:20:30", "2024-01-05T10:20:30Z"),
        ("2024-01-05T10:20:30", "2024-01-05T10:20:30Z"),
        ("20240105", "2024-01-05T00:00:00Z"),
        ("5 Jan 2024", "2024-01-05T00:00:00Z"),
        ("January 5, 2024", "2024-01-05T00:00:00Z"),
        ("soon", "soon"),
        ("2024-01-05T10:00", "2024-01-05T10:00:00Z"),
        ("2024-1-5", "2024-01-05T00:00:00Z"),
        ("2024-01-05T10:00:00+02:00", "2024-01-05T10:00:00Z"),
        ("2024-01-05T10:00:00.250Z", "2024-01-05T10:00:00Z"),
        ("5 January 2024 10:00", "2024-01-05T10:00:00Z"),
        ("Jan 5 2024", "2024-01-05T00:00:00Z"),
        ("Friday, 5th of Jan. 2024 at 9:07 pm UTC", "2024-01-05T21:07:00Z"),
        ("2024 Jan 5 12:30 am", "2024-01-05T00:30:00Z"),
        ("20240105T102030", "2024-01-05T10:20:30Z"),
        ("202401051020", "2024-01-05T10:20:00Z"),
        ("13/01/2024", "2024-01-13T00:00:00Z"),
        ("01/13/2024 -0500", "01/13/2024 -0500"),
        ("2024-02-30", "2024-02-30"),
        ("Janus 5 2024", "Janus 5 2024"),
        ("5 Jan 2024 25:00", "5 Jan 2024 25:00"),
        ("1 2 3 2024", "1 2 3 2024"),
        ("", ""),
        (None, None),
    ],
)
def test_iso_utc(spark, raw, want):
    assert one(spark, cal.iso_utc(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "name, base, plain",
    [
        ("tas_file.nc", "tas_file.nc", True),
        ("ScenarioMIP_250km_tas_file.nc", "tas_file.nc", False),
        ("CMIP6_file.nc", "file.nc", False),
        ("CMIP6_CMIP5_file.nc", "CMIP5_file.nc", False),
        ("other_file.nc", "other_file.nc", False),
        ("tasmax_file.nc", "tasmax_file.nc", False),
    ],
)
def test_base_filename(spark, name, base, plain):
    assert one(spark, naming.base_filename(F.lit(name))) == base
    assert one(spark, naming.is_plain(F.lit(name))) is plain


def test_output_names(spark):
    name, rel = F.lit("a.b.nc"), F.lit("x/y")
    assert one(spark, naming.output_name(name, rel, "clipped", True)) == "x/y/a.b_clipped.nc"
    assert one(spark, naming.output_name(name, F.lit(""), "clipped", True)) == "a.b_clipped.nc"
    assert one(spark, naming.output_name(name, rel, "monthly_mean", False)) == "a.b_monthly_mean.nc"


@pytest.mark.parametrize("lat, want", [(45.5, "N45"), (-10.1, "S11"), (0.0, "N00"), (-0.5, "S01")])
def test_copernicus_lat(spark, lat, want):
    assert one(spark, naming.copernicus_lat(F.lit(lat))) == want


@pytest.mark.parametrize("lon, want", [(5.0, "E005"), (-93.2, "W094"), (170.0, "E170")])
def test_copernicus_lon(spark, lon, want):
    assert one(spark, naming.copernicus_lon(F.lit(lon))) == want


@pytest.mark.parametrize("lat, lon, want", [(42, -93, "n42w093"), (5, 7, "n05w007"), (-5, -120, "n-5w120"), (-12, 0, "n-12w000")])
def test_usgs_tile(spark, lat, lon, want):
    assert one(spark, naming.usgs_tile(F.lit(lat), F.lit(lon))) == want


def test_paths_default_to_unknown(spark):
    facets = F.create_map(
        F.lit("activity_id"), F.array(F.lit("HighResMIP")),
        F.lit("variable_id"), F.array(F.lit("tas")),
        F.lit("nominal_resolution"), F.array(F.lit("250 km")),
    )
    assert one(spark, naming.path_cmip6(F.lit("file.nc"), facets, "structured")) == "tas/250km/HighResMIP/file.nc"
    assert one(spark, naming.path_cmip6(F.lit("file.nc"), facets, "flat", "p_")) == "p_HighResMIP_250km_file.nc"
    empty = F.create_map().cast("map<string,array<string>>")
    title = F.lit(None).cast("string")
    assert one(spark, naming.path_cmip6(title, empty, "structured")) == "unknown/unknown_resolution/unknown/unknown_file.nc"
    assert one(spark, naming.path_cmip5(title, empty, "structured")) == "unknown/unknown/unknown/unknown/unknown_file.nc"


def test_split_list(spark):
    assert one(spark, naming.split_list(F.lit(" a, ,b ,"))) == ["a", "b"]


@pytest.mark.parametrize("lat", [-90.0, -60.5, 0.0, 12.25, 89.0, 90.0])
def test_equal_area_latitudes_go_back(spark, lat):
    from cellweave.functions import coords

    y = coords.lat_to_metres(lat)
    assert coords.lat_of_metres(y) == pytest.approx(lat, abs=1e-6)
    assert one(spark, coords.equal_area_y(F.lit(lat))) == pytest.approx(y, abs=1e-6)
    assert one(spark, coords.equal_area_x(F.lit(coords.metres_to_lon(5000.0)))) == pytest.approx(5000.0)
    assert coords.lat_of_metres(1e9) == 90 and coords.lat_of_metres(-1e9) == -90
