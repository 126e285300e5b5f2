"""Bounding-box crop.

The row filter is a plain predicate: no shuffle, and its literal part reaches the Parquet reader.
Status and contiguity work on the coordinate axes (one row per axis entry), never on the cube.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cellweave.functions.coords import check_box, lat_in_box, lon_in_box, lon_near_box, normalized_in_box
from cellweave.session import stage

NO_DATA = "No data in bounds"
NO_COORDS = "Missing coordinate variables"
SPLIT_WINDOW = "Window is not contiguous"


def crop(cells: DataFrame, box: dict) -> DataFrame:
    """Rows inside the box; a variable without latitude or longitude is not cut in that direction.

    Longitudes are compared on -180..180, the output keeps them as stored.
    """
    check_box(box)
    lat, lon = F.col("lat"), F.col("lon")
    # The pushable superset of the longitude test is a filter of its own, and the exact one shares no part
    # with it: the optimizer would merge common parts into one test that can't be pushed.
    return (
        cells.where(lat.isNull() | lat_in_box(lat, box))
        .where(lon.isNull() | lon_near_box(lon, box))
        .where(F.coalesce(normalized_in_box(lon, box), F.lit(True)))
    )


def crop_inside(cells: DataFrame, box: dict) -> DataFrame:
    """Rows of variables on both axes that lie inside the box."""
    check_box(box)
    return cells.where(lat_in_box(F.col("lat"), box) & lon_in_box(F.col("lon"), box))


def axis_windows(coords: DataFrame, box: dict) -> DataFrame:
    """Per file: how many axis entries fall into the box, and over which index range."""
    check_box(box)
    is_lat, is_lon = F.col("role") == "lat", F.col("role") == "lon"
    in_lat = is_lat & lat_in_box(F.col("value"), box)
    in_lon = is_lon & lon_in_box(F.col("value"), box)
    idx = F.col("idx")

    def span(match):
        return F.max(F.when(match, idx)) - F.min(F.when(match, idx)) + 1

    return coords.groupBy("file_id").agg(
        F.count_if(is_lat).alias("lat_size"),
        F.count_if(is_lon).alias("lon_size"),
        F.count_if(in_lat).alias("lat_count"),
        F.count_if(in_lon).alias("lon_count"),
        span(in_lat).alias("lat_span"),
        span(in_lon).alias("lon_span"),
    )


def crop_contiguity(coords: DataFrame, box: dict) -> DataFrame:
    """Whether each file's matching indices form one run; a box across the seam of the grid does not."""
    windows = axis_windows(coords, box)
    return windows.where((F.col("lat_count") > 0) & (F.col("lon_count") > 0)).select(
        "file_id",
        "lat_count",
        "lon_count",
        "lat_span",
        "lon_span",
        ((F.col("lat_count") == F.col("lat_span")) & (F.col("lon_count") == F.col("lon_span"))).alias("contiguous"),
    )


def crop_status(files: DataFrame, coords: DataFrame, box: dict, strict: bool = False) -> DataFrame:
    """``(file_id, ok, message)``; ``strict`` also fails files whose window is split."""
    lat_ok, lon_ok = F.coalesce(F.col("lat_count"), F.lit(0)) > 0, F.coalesce(F.col("lon_count"), F.lit(0)) > 0
    message = F.when(
        (F.coalesce(F.col("lat_size"), F.lit(0)) == 0) | (F.coalesce(F.col("lon_size"), F.lit(0)) == 0), NO_COORDS
    ).when(~(lat_ok & lon_ok), NO_DATA)
    if strict:
        message = message.when(
            (F.col("lat_count") != F.col("lat_span")) | (F.col("lon_count") != F.col("lon_span")), SPLIT_WINDOW
        )
    return (
        files.select("file_id")
        .join(axis_windows(coords, box), "file_id", "left")
        .select("file_id", message.isNull().alias("ok"), F.coalesce(message, F.lit("ok")).alias("message"))
    )


def drop_failed(cells: DataFrame, status: DataFrame) -> DataFrame:
    """Cells of the files that did not fail.

    The failed ids are staged, so that the optimizer plans the join with the cube by their true size
    and a short list does not cause a shuffle of the cube by file.
    """
    failed = stage(status.where(~F.col("ok")).select("file_id"), "failed")
    return cells.join(failed, "file_id", "left_anti")


def crop_to_areas(cells: DataFrame, areas: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """One copy of each cell per named area (north, south, east, west) that holds it.

    The areas are literals, so this is an array of matching names per row and no join.
    """
    lat, lon = F.col("lat"), F.col("lon")
    boxes = {
        name: {"min_lat": s, "max_lat": n, "min_lon": w, "max_lon": e} for name, (n, s, e, w) in areas.items()
    }
    tests = {name: lat_in_box(lat, box) & lon_in_box(lon, box) for name, box in boxes.items()}
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))
    any_area = reduce(lambda a, b: a | b, tests.values())
    return cells.where(any_area).select("*", F.explode(names).alias("area"))
