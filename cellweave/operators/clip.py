"""Polygon clip: which grid points lie strictly inside the union of the polygons.

Points and edges are never paired. For each distinct latitude the edges that span it give their
crossing longitudes; cells and crossings are then put in one order along the latitude and a running
count of open polygons decides. The work is proportional to points + crossings.

Each latitude is scanned twice, an infinitesimal step above and below. Crossings at the same
longitude are ordered by the way their edges lean, so the count is known in every sector around a
point. A point is inside if no sector around it is outside. Hence a point on an outer border, a hole's
border or a vertex is out, while a point on a border that two polygons share is in, as it would be
after dissolving them into one shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweave.functions.coords import (
    equal_area_x,
    equal_area_y,
    lat_in_box,
    lat_of_metres,
    lat_to_metres,
    lon_near_box,
    metres_to_lon,
    normalize_lon,
    segment_distance,
)
from cellweave.session import dealt, stage as stage_table
from cellweave.sources.boundaries import extent

OUTSIDE_EXTENT = "Outside bounds"
NO_POINT_INSIDE = "No intersection"
NO_COORDS = "No coordinates found"

# Height in degrees of the latitude bands that edges and latitudes are matched on, if nothing is measured, and
# how many bands an edge of mean height spans where it is (``band_height``).
BAND = 0.25
BANDS_OF_AN_EDGE = 4
# Width in degrees of the longitude blocks that split the points of one latitude.
BLOCK = 1.0


def grid_points(cells: DataFrame) -> DataFrame:
    """Distinct ``(lat, lon)``, longitude on -180..180. Reads just these two columns of the cube."""
    lat, lon = F.col("lat"), F.col("lon")
    known = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    # Adding zero turns -0.0 into 0.0.
    return cells.where(known).select((lat + 0.0).alias("lat"), (normalize_lon(lon) + 0.0).alias("lon")).distinct()


def within_extent(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points inside the bounding box of the edges (a scalar subquery that reaches the scan)."""
    box = extent(edges)

    def side(name: str) -> Column:
        return box.select(name).scalar()

    return points.where(
        (F.col("lat") >= side("min_lat"))
        & (F.col("lat") <= side("max_lat"))
        & (F.col("lon") >= side("min_lon"))
        & (F.col("lon") <= side("max_lon"))
    )


def _polygon_key(edges: DataFrame) -> list[str]:
    return [c for c in ("region_id", "polygon_id", "part_id") if c in edges.columns]


def band_height(box: dict) -> float:
    """Bands that suit the edges: a coast of short ones is cut into low bands, so none holds very many of them."""
    return max(box["mean_height"] / BANDS_OF_AN_EDGE, (box["max_lat"] - box["min_lat"]) / (1 << 20)) or BAND


def _crossings(lats: DataFrame, edges: DataFrame, height: float = BAND) -> DataFrame:
    """Where edges cross each latitude: ``part, lat, scan, <polygon>, x, lean``.

    Equi-join on latitude bands. ``scan`` is +1 just above the latitude and -1 just below. ``part`` is a whole
    number for band and polygon together that edges are shuffled by: where the latitudes measure small they are
    broadcast, so the crossings of a polygon arise in one place and need no shuffle of their own.
    """
    up = F.col("y1") < F.col("y2")
    # Both uses of a border shared by two polygons get the same end first, hence the same rounding.
    oriented = edges.where(F.col("y1") != F.col("y2")).select(
        *_polygon_key(edges),
        F.when(up, F.col("x1")).otherwise(F.col("x2")).alias("xa"),
        F.when(up, F.col("y1")).otherwise(F.col("y2")).alias("ya"),
        F.when(up, F.col("x2")).otherwise(F.col("x1")).alias("xb"),
        F.when(up, F.col("y2")).otherwise(F.col("y1")).alias("yb"),
    )
    banded = oriented.withColumn("band", F.explode(F.sequence(F.floor(F.col("ya") / height), F.floor(F.col("yb") / height))))
    lat = F.col("lat")
    banded = dealt(banded.withColumn("part", F.xxhash64("band", *_polygon_key(edges))), "part")
    met = banded.join(lats.withColumn("band", F.floor(lat / height)), "band").where((lat >= F.col("ya")) & (lat <= F.col("yb")))
    scans = F.array_compact(
        F.array(F.when(lat < F.col("yb"), F.lit(1)), F.when(lat > F.col("ya"), F.lit(-1)))
    )
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    return met.select(
        "part",
        "lat",
        *_polygon_key(edges),
        (dx * (lat - F.col("ya")) / dy + F.col("xa")).alias("x"),
        (dx / dy).alias("slope"),
        F.explode(scans).alias("scan"),
    ).select("part", "lat", "scan", *_polygon_key(edges), "x", (F.col("slope") * F.col("scan")).alias("lean"))


def _strip(x: Column) -> list[Column]:
    """``block`` of a longitude, and ``strip``, a whole number for latitude and block together.

    Rows are shuffled by ``strip``. Groupings name it beside the latitude, so they find their rows
    in place; grouping on a double alone would shuffle again.
    """
    block = F.floor(x / BLOCK)
    return [block.alias("block"), F.xxhash64("lat", block).alias("strip")]


_PLACE = ["strip", "lat", "block"]
_COUNTS = ["up", "down", "up_dip", "down_dip"]


def _events(lats: DataFrame, edges: DataFrame, height: float = BAND) -> DataFrame:
    """One row per latitude and crossing longitude.

    ``up``/``down``: change of the number of open polygons in the upper and lower scan;
    ``up_dip``/``down_dip``: lowest value reached while passing, relative to the count before.
    """
    crossings = _crossings(lats, edges, height)
    along = Window.partitionBy("part", "lat", "scan", *_polygon_key(edges)).orderBy("x", "lean")
    # Odd crossings of a polygon open it, even ones close it: all rings together, so holes drop out.
    opened = crossings.withColumn("delta", F.when(F.row_number().over(along) % 2 == 1, 1).otherwise(-1))
    placed = opened.select("part", "lat", *_strip(F.col("x")), "x", "scan", "lean", "delta")
    here = placed.groupBy("part", *_PLACE, "x", "scan", "lean").agg(F.sum("delta").alias("delta"))  # in place: borders that polygons share
    sectors = here.repartition("strip").groupBy(*_PLACE, "x", "scan", "lean").agg(F.sum("delta").alias("delta"))
    turn = Window.partitionBy(*_PLACE, "x", "scan").orderBy("lean").rowsBetween(Window.unboundedPreceding, 0)
    passing = sectors.withColumn("reached", F.sum("delta").over(turn))
    above, below = F.col("scan") == 1, F.col("scan") == -1
    zero = F.lit(0)
    return passing.groupBy(*_PLACE, "x").agg(
        F.coalesce(F.sum(F.when(above, F.col("delta"))), zero).alias("up"),
        F.coalesce(F.sum(F.when(below, F.col("delta"))), zero).alias("down"),
        F.least(F.coalesce(F.min(F.when(above, F.col("reached"))), zero), zero).alias("up_dip"),
        F.least(F.coalesce(F.min(F.when(below, F.col("reached"))), zero), zero).alias("down_dip"),
    )


def inside_points(points: DataFrame, edges: DataFrame, height: float = BAND) -> DataFrame:
    """The distinct ``(lat, lon)`` of ``points`` strictly inside the union of the polygons."""
    near = within_extent(points, edges)
    none = [F.lit(0).cast("long").alias(c) for c in _COUNTS]
    events = _events(stage_table(near.select("lat").distinct(), "latitudes"), edges, height)
    marks = (
        events.select(*_PLACE, "x", *_COUNTS, F.lit(False).alias("is_point"))
        .unionByName(
            near.select("lat", *_strip(F.col("lon")), F.col("lon").alias("x"), *none, F.lit(True).alias("is_point"))
        )
        .repartition("strip")
        .groupBy(*_PLACE, "x")
        .agg(
            *[F.sum(c).alias(c) for c in ("up", "down")],
            *[F.min(c).alias(c) for c in ("up_dip", "down_dip")],
            F.max("is_point").alias("is_point"),
        )
    )
    # Count carried into each block: a window over at most 360 / BLOCK + 1 rows per latitude.
    before_block = Window.partitionBy("lat").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marks.groupBy(*_PLACE)
        .agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        .select(
            *_PLACE,
            F.lit(float("-inf")).alias("x"),
            *[F.coalesce(F.sum(c).over(before_block), F.lit(0)).alias(c) for c in ("up", "down")],
            *none[2:],
            F.lit(False).alias("is_point"),
        )
    )
    before = Window.partitionBy(*_PLACE).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    swept = (
        marks.unionByName(carried)
        .repartition("strip")
        .select(
            "lat",
            "x",
            "is_point",
            (F.coalesce(F.sum("up").over(before), F.lit(0)) + F.col("up_dip")).alias("least_up"),
            (F.coalesce(F.sum("down").over(before), F.lit(0)) + F.col("down_dip")).alias("least_down"),
        )
    )
    return swept.where(F.col("is_point") & (F.col("least_up") > 0) & (F.col("least_down") > 0)).select(
        "lat", F.col("x").alias("lon")
    )


def _buffer_tiles(edges: DataFrame, size: float, reach: float) -> DataFrame:
    """Edges on the metre grid, one row per square tile within ``reach`` of them.

    Long edges are cut at tile columns first, so an edge meets about length / size tiles and not the
    square of it.
    """
    metres = edges.select(
        equal_area_x(F.col("x1")).alias("ax"),
        equal_area_y(F.col("y1")).alias("ay"),
        equal_area_x(F.col("x2")).alias("bx"),
        equal_area_y(F.col("y2")).alias("by"),
    ).distinct()
    left, right = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = metres.withColumn(
        "tx", F.explode(F.sequence(F.floor((left - reach) / size), F.floor((right + reach) / size)))
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    # Part of the edge that can be within reach of this column.
    c0 = F.greatest(left, F.col("tx") * size - reach)
    c1 = F.least(right, (F.col("tx") + 1) * size + reach)

    def y_at(x: Column) -> Column:
        return F.when(dx != 0, F.col("ay") + dy * (x - F.col("ax")) / dx)

    low = F.when(dx != 0, F.least(y_at(c0), y_at(c1))).otherwise(F.least("ay", "by"))
    high = F.when(dx != 0, F.greatest(y_at(c0), y_at(c1))).otherwise(F.greatest("ay", "by"))
    # A metre of room for rounding in y_at.
    return columns.withColumn(
        "ty", F.explode(F.sequence(F.floor((low - reach - 1) / size), F.floor((high + reach + 1) / size)))
    )


def near_points(points: DataFrame, edges: DataFrame, buffer_km: float, tile_km: float = 50.0) -> DataFrame:
    """Points whose distance to some edge, in equal-area metres, is at most ``buffer_km``.

    A left-semi equi-join on tiles: a point stops at its first edge and no pair is put out.
    """
    reach = buffer_km * 1000.0
    size = max(tile_km * 1000.0, reach)
    tiles = _buffer_tiles(edges, size, reach)
    placed = (
        points.withColumn("px", equal_area_x(F.col("lon")))
        .withColumn("py", equal_area_y(F.col("lat")))
        .withColumn("tx", F.floor(F.col("px") / size))
        .withColumn("ty", F.floor(F.col("py") / size))
    )
    close = segment_distance(placed.px, placed.py, tiles.ax, tiles.ay, tiles.bx, tiles.by) <= reach
    return placed.join(tiles, (placed.tx == tiles.tx) & (placed.ty == tiles.ty) & close, "left_semi").select(
        "lat", "lon"
    )


def covered_points(points: DataFrame, edges: DataFrame, buffer_km: float = 0.0, height: float = BAND) -> DataFrame:
    """Points inside the polygons, or inside them grown by ``buffer_km``."""
    inside = inside_points(points, edges, height)
    if buffer_km <= 0:
        return inside
    return inside.unionByName(near_points(points, edges, buffer_km)).distinct()


def grown_extent(edges: DataFrame, buffer_km: float = 0.0) -> dict | None:
    """The bounding box of the edges, grown by the buffer in equal-area metres, and their ``mean_height``; nothing without edges."""
    box = extent(edges, F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("mean_height")).first().asDict()
    if box["min_lat"] is None:
        return None
    if buffer_km > 0:
        reach = buffer_km * 1000.0 * (1 + 1e-9)
        for side, sign in (("min", -1), ("max", 1)):
            box[f"{side}_lon"] += sign * metres_to_lon(reach)
            box[f"{side}_lat"] = lat_of_metres(lat_to_metres(box[f"{side}_lat"]) + sign * reach)
    return box


def points_in_reach(cells: DataFrame, box: dict | None) -> DataFrame:
    """The distinct points of a cube inside a box. The box is made of literals, so the reader skips what lies outside."""
    if box is None:
        return grid_points(cells).limit(0)
    return grid_points(cells.where(lat_in_box(F.col("lat"), box)).where(lon_near_box(F.col("lon"), box)))


def region_mask(cells: DataFrame, edges: DataFrame, buffer_km: float = 0.0, points: DataFrame | None = None) -> DataFrame:
    """The covered points of a cube, computed once and written to the shared scratch folder.

    ``points`` may give the grid's points when a coordinate table has them, which saves reading the
    cube. Staging lets the optimizer see the mask's true size before it plans the join with the cube:
    a mask below the broadcast threshold is broadcast and the cube is not shuffled.
    """
    # Staged as well: points and edges are read several times below, the cube and the boundary texts
    # should be read once.
    edges = stage_table(edges, "edges")
    box = grown_extent(edges, buffer_km)
    points = stage_table(points_in_reach(cells, box), "points") if points is None else points
    return stage_table(covered_points(points, edges, buffer_km, band_height(box) if box else BAND), "mask")


def clip_filter(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Only the rows whose grid point is in the mask.

    The mask's ranges are filters on the stored columns, so the reader skips what lies outside them; a point
    of the mask has a latitude of the cube, unchanged, and a longitude on -180..180.
    """
    m = mask.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    span = mask.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon")).first()
    if span["min_lat"] is None:
        return cells.limit(0)
    cells = cells.where(lat_in_box(F.col("lat"), span.asDict())).where(lon_near_box(F.col("lon"), span.asDict()))
    return cells.join(m, (F.col("lat") == F.col("_lat")) & (normalize_lon(F.col("lon")) == F.col("_lon")), "left_semi")


def clip_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """All rows; values outside the mask become the fill value, or NaN without one.

    ``cells`` may have ``fill_value``. Variables that lack latitude or longitude pass unchanged.
    """
    fill = F.coalesce(F.col("fill_value"), F.lit(float("nan"))) if "fill_value" in cells.columns else F.lit(float("nan"))
    m = mask.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("_in"))
    on_grid = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    joined = cells.join(
        m, (F.col("lat") == F.col("_lat")) & (normalize_lon(F.col("lon")) == F.col("_lon")), "left"
    )
    return joined.withColumn("value", F.when(on_grid & F.col("_in").isNull(), fill).otherwise(F.col("value"))).drop(
        "_lat", "_lon", "_in"
    )


def clip_status(
    files: DataFrame, cells: DataFrame, edges: DataFrame, mask: DataFrame, buffer_km: float = 0.0
) -> DataFrame:
    """Per file ``(file_id, ok, message)``; the bounds are those of the boundary grown by ``buffer_km``.

    ``cells`` needs ``file_id, lat, lon`` only; it is reduced to each file's distinct points before the
    mask is looked up. The extent of the boundary enters as scalar subqueries.
    """
    m = mask.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("_in"))
    lon = normalize_lon(F.col("lon"))
    seen = (
        cells.select("file_id", "lat", lon.alias("lon"))
        .distinct()
        .join(m, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")), "left")
        .groupBy("file_id")
        .agg(
            F.min("lat").alias("lat0"),
            F.max("lat").alias("lat1"),
            F.min("lon").alias("lon0"),
            F.max("lon").alias("lon1"),
            F.coalesce(F.bool_or("_in"), F.lit(False)).alias("hit"),
        )
    )
    box = extent(edges)
    if buffer_km > 0:  # in the equal-area metres that the buffer is measured in
        x, y, reach = equal_area_x, equal_area_y, buffer_km * 1000.0
    else:
        x, y, reach = (lambda c: c), (lambda c: c), 0.0
    apart = (
        (x(F.col("lon1")) < x(box.select("min_lon").scalar()) - reach)
        | (x(F.col("lon0")) > x(box.select("max_lon").scalar()) + reach)
        | (y(F.col("lat1")) < y(box.select("min_lat").scalar()) - reach)
        | (y(F.col("lat0")) > y(box.select("max_lat").scalar()) + reach)
    )
    message = (
        F.when(F.col("lat0").isNull() | F.col("lon0").isNull(), NO_COORDS)
        .when(apart, OUTSIDE_EXTENT)
        .when(~F.col("hit"), NO_POINT_INSIDE)
    )
    return (
        files.select("file_id")
        .join(seen, "file_id", "left")
        .select("file_id", message.isNull().alias("ok"), F.coalesce(message, F.lit("Clipped")).alias("message"))
    )


def extents(cells: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box of the grid points per group."""
    lon = normalize_lon(F.col("lon"))
    return cells.groupBy(*by).agg(
        F.min(lon).alias("min_lon"),
        F.max(lon).alias("max_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
    )

