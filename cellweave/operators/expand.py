"""Expected files from requests: variables x dates and latitude x longitude tiles.

A request is a row; its dates and tiles are arrays made in that row and exploded. No cross join.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellweave.constants import (
    COP30_BUCKET,
    COP30_REGION,
    ERA5_BUCKET,
    ERA5_VARIABLES,
    USGS_BUCKET,
    USGS_REGION,
)
from cellweave.functions.calendar import month_chain
from cellweave.functions.naming import split_list
from cellweave.functions.naming import (
    copernicus_lat,
    copernicus_lon,
    path_prism,
    prism_name,
    prism_url,
    usgs_tile,
)


def era5_variables(spark: SparkSession) -> DataFrame:
    """The variable map: ``code, part, folder, file_code, descr``."""
    rows, parts = [], {}
    for code, folder, file_code, descr in ERA5_VARIABLES:
        parts[code] = parts.get(code, -1) + 1
        rows.append((code, parts[code], folder, file_code, descr))
    return spark.createDataFrame(rows, "code string, part int, folder string, file_code string, descr string")


def era5_code(text: Column) -> Column:
    """``"t2m (2m temperature)"`` to ``"t2m"``."""
    return F.lower(F.trim(F.split_part(text, F.lit("("), F.lit(1))))


def era5_parts(code: Column) -> Column:
    """The parts of a code as an array of structs; NULL for an unknown code.

    The map is a fixed list of under a hundred rows, held as one literal map: no join.
    """
    by_code: dict[str, list[Column]] = {}
    for name, folder, file_code, descr in ERA5_VARIABLES:
        by_code.setdefault(name, []).append(
            F.struct(F.lit(folder).alias("folder"), F.lit(file_code).alias("file_code"), F.lit(descr).alias("descr"))
        )
    entries = [x for name, parts in by_code.items() for x in (F.lit(name), F.array(*parts))]
    return F.try_element_at(F.create_map(*entries), code)


def era5_expand(requests: DataFrame) -> DataFrame:
    """Monthly files of each request ``(…, variable, start, end)``; unknown variables drop out."""
    months = F.when(
        F.trunc("start", "month") <= F.col("end"),
        F.sequence(F.trunc("start", "month"), F.col("end"), F.expr("interval 1 month")),
    )
    rest = [c for c in requests.columns if c not in ("variable", "start", "end")]
    folder, code, month = F.col("p.folder"), F.col("p.file_code"), F.col("month_start")
    return (
        requests.withColumn("code", era5_code(F.col("variable")))
        .select(*rest, "code", "start", "end", F.posexplode(era5_parts(F.col("code"))).alias("part", "p"))
        .select(*rest, "code", "part", "p", F.explode(months).alias("month_start"))
        .select(
            *rest,
            F.col("code").alias("variable"),
            "part",
            F.col("p.descr").alias("description"),
            F.year(month).alias("year"),
            F.month(month).alias("month"),
            F.concat(
                folder, F.lit("/"), F.date_format(month, "yyyyMM"), F.lit("/"), folder, F.lit("."), code, F.lit(".")
            ).alias("prefix"),
            F.lit(ERA5_BUCKET).alias("bucket"),
        )
    )


def era5_requests(requests: DataFrame) -> DataFrame:
    """Requests with a comma list of ``variables`` as one request per ``variable``; empty entries drop out."""
    return requests.withColumn("variable", F.explode(split_list(F.col("variables")))).drop("variables")


def era5_unknown(requests: DataFrame) -> DataFrame:
    """Requests whose variable is not in the map."""
    code = era5_code(F.col("variable"))
    return requests.where(era5_parts(code).isNull()).withColumn("code", code)


def era5_listing(variables: DataFrame) -> DataFrame:
    """Variables for display: descriptions of a composite joined with ``&``, codes with ``+``."""
    parts = F.sort_array(F.collect_list(F.struct("part", "descr", "file_code")))
    listed = variables.groupBy("code").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["descr"]), " & ")
    return listed.select(
        "code",
        F.when(F.size("parts") > 1, F.concat(F.lit("[Composite] "), text)).otherwise(text).alias("description"),
        F.array_join(F.transform("parts", lambda p: p["file_code"]), " + ").alias("file_code"),
    )


def prism_expand(requests: DataFrame, resolution: str = "4km", time_step: str = "daily") -> DataFrame:
    """Files of each request ``(…, variables array, start, end)``, one per variable and date."""
    if time_step == "monthly":
        dates = month_chain(F.col("start"), F.col("end"))
    else:
        dates = F.when(
            F.col("start") <= F.col("end"), F.sequence(F.col("start"), F.col("end"), F.expr("interval 1 day"))
        )
    rest = [c for c in requests.columns if c not in ("variables", "start", "end")]
    variable, date = F.col("variable"), F.col("date")
    name = prism_name(variable, resolution, date, time_step)
    return (
        requests.select(*rest, "variables", F.explode(dates).alias("date"))
        .select(*rest, F.explode("variables").alias("variable"), "date")
        .select(
            *rest,
            "variable",
            "date",
            name.alias("filename"),
            prism_url(variable, resolution, date, time_step).alias("url"),
            path_prism(variable, F.lit(resolution), name).alias("output_path"),
        )
    )


def normalize_bounds(bounds: Any) -> dict[str, float]:
    """A mapping or ``[north, south, east, west]`` as a checked mapping."""
    if isinstance(bounds, dict):
        out = {k: float(bounds[k]) for k in ("north", "south", "east", "west")}
    elif isinstance(bounds, (list, tuple)) and len(bounds) == 4:
        out = dict(zip(("north", "south", "east", "west"), map(float, bounds)))
        if out["north"] == out["south"]:
            raise ValueError("north must be greater than south")
    else:
        raise ValueError("expected four bounds: north, south, east, west")
    if out["north"] < out["south"]:
        raise ValueError("north must be greater than south")
    if out["east"] < out["west"]:
        raise ValueError("east must be greater than west")
    return out


def validate_bounds(bounds: DataFrame, from_list: bool = False) -> DataFrame:
    """Add ``ok`` and ``message`` to rows of ``north, south, east, west``.

    ``from_list`` is the stricter rule for four bare numbers, which also rejects equal latitudes.
    """
    north, south = F.col("north"), F.col("south")
    flat = north <= south if from_list else north < south
    message = F.when(flat, "North must be greater than South").when(
        F.col("east") < F.col("west"), "East must be greater than West"
    )
    return bounds.withColumn("ok", message.isNull()).withColumn("message", F.coalesce(message, F.lit("ok")))


def _degrees(low: Column, high: Column) -> Column:
    low, high = low.cast("int"), high.cast("int")
    return F.explode(F.when(low <= high, F.sequence(low, high)))


def dem_tiles_cop30(bounds: DataFrame) -> DataFrame:
    """Global 30 m tiles that meet each box, both edges included."""
    rest = [c for c in bounds.columns if c not in ("north", "south", "east", "west")]
    lat, lon = F.col("lat"), F.col("lon")
    base = F.concat(
        F.lit("Copernicus_DSM_COG_10_"), copernicus_lat(lat), F.lit("_00_"), copernicus_lon(lon), F.lit("_00_DEM")
    )
    return (
        bounds.select("*", _degrees(F.floor("south"), F.floor("north")).alias("lat"))
        .select("*", _degrees(F.floor("west"), F.floor("east")).alias("lon"))
        .select(
            *rest,
            "lat",
            "lon",
            F.concat(base, F.lit(".tif")).alias("filename"),
            F.concat(base, F.lit("/"), base, F.lit(".tif")).alias("key"),
            F.lit(COP30_BUCKET).alias("bucket"),
            F.lit("COP30").alias("source"),
            F.lit(COP30_REGION).alias("region"),
        )
    )


def dem_tiles_usgs(bounds: DataFrame) -> DataFrame:
    """Regional 10 m tiles that meet each box; the folder is found later."""
    rest = [c for c in bounds.columns if c not in ("north", "south", "east", "west")]
    tile = usgs_tile(F.col("lat"), F.col("lon"))
    return (
        bounds.select("*", _degrees(F.ceil("south"), F.ceil("north")).alias("lat"))
        .select("*", _degrees(F.floor("west"), F.floor("east")).alias("lon"))
        .select(
            *rest,
            "lat",
            "lon",
            tile.alias("tile_id"),
            F.concat(F.lit("USGS_13_"), tile, F.lit(".tif")).alias("filename"),
            F.lit(USGS_BUCKET).alias("bucket"),
            F.lit("USGS10m").alias("source"),
            F.lit(USGS_REGION).alias("region"),
        )
    )


def dem_union(bounds: DataFrame) -> DataFrame:
    """Tiles of both sources for each box."""
    return dem_tiles_cop30(bounds).unionByName(dem_tiles_usgs(bounds), allowMissingColumns=True)
