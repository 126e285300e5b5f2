"""Polygon boundaries as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RING = "array<struct<x:double,y:double>>"
_COORDS = "array<array<array<array<double>>>>"


def wkt_polygons(wkt: Column) -> Column:
    """WKT ``POLYGON`` or ``MULTIPOLYGON`` text as polygons > rings > positions.

    The text is rewritten to a JSON array by a few replacements and parsed by Spark.
    """
    body = F.regexp_replace(wkt, r"^\s*(?i:MULTI)?(?i:POLYGON)\s*(?i:Z|M|ZM)?\s*", "")
    number = r"[-+0-9.eE]+"
    body = F.regexp_replace(body, rf"({number})\s+({number})(?:\s+{number})*", "[$1,$2]")
    body = F.translate(body, "()", "[]")
    single = wkt.rlike(r"^\s*(?i:POLYGON)")
    return F.from_json(F.when(single, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body), _COORDS)


def geojson_polygons(geometry: Column) -> Column:
    """GeoJSON geometry text (``Polygon`` or ``MultiPolygon``) as polygons > rings > positions."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    return F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), coords, F.lit("]"))).otherwise(coords), _COORDS)


def boundary_edges(shapes: DataFrame, polygons: Column) -> DataFrame:
    """One row per edge. ``shapes`` has ``region_id`` and ``polygon_id``.

    Rings are closed here whether or not the last position repeats the first; edges of length zero
    are left out. Parts of a multi-polygon are told apart by ``part_id``.
    """

    def edges(ring: Column) -> Column:
        return F.transform(
            ring,
            lambda p, i: F.struct(
                i.alias("seg"),
                p[0].alias("x1"),
                p[1].alias("y1"),
                F.get(ring, (i + 1) % F.size(ring))[0].alias("x2"),
                F.get(ring, (i + 1) % F.size(ring))[1].alias("y2"),
            ),
        )

    return (
        shapes.select("region_id", "polygon_id", F.posexplode(polygons).alias("part_id", "rings"))
        .select("region_id", "polygon_id", "part_id", F.posexplode("rings").alias("ring_id", "ring"))
        .select("region_id", "polygon_id", "part_id", "ring_id", F.explode(edges(F.col("ring"))).alias("e"))
        .select("region_id", "polygon_id", "part_id", "ring_id", "e.*")
        .where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    )


def read_geojson_regions(spark: SparkSession, path: str, region_field: str = "name") -> DataFrame:
    """Edges from line-delimited GeoJSON features (one feature per line)."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    shapes = lines.select(
        F.get_json_object("value", f"$.properties.{region_field}").alias("region_id"),
        F.xxhash64("value").alias("polygon_id"),
        F.get_json_object("value", "$.geometry").alias("geometry"),
    )
    return boundary_edges(shapes, geojson_polygons(F.col("geometry")))


def extent(edges: DataFrame, *more: Column) -> DataFrame:
    """One row: the bounding box of all edges, whichever way they run, and ``more`` aggregates of them."""
    return edges.agg(
        F.min(F.least("x1", "x2")).alias("min_lon"),
        F.max(F.greatest("x1", "x2")).alias("max_lon"),
        F.min(F.least("y1", "y2")).alias("min_lat"),
        F.max(F.greatest("y1", "y2")).alias("max_lat"),
        *more,
    )
