"""Grid tables derived by Spark from the driver's tables. Every view grows with its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellweave.constants import ERA5_VARIABLES
from cellweave.operators.expand import prism_expand
from cellweave.schemas import GRID_VARS
from cellweave.sources.boundaries import boundary_edges, wkt_polygons

ERA5_CODES = list(dict.fromkeys(row[0] for row in ERA5_VARIABLES))
UNKNOWN_CODES = ["wave_height", "ozone hole", ""]
STATES = ["P", "O", "F"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """The entry of a literal list at a zero-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def whole(a: Column, b: int) -> Column:
    return F.floor(a / b)


def _cell_value() -> Column:
    q, o, n = F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber") % 3
    return (
        F.when(o % 17 == 0, F.lit(None).cast("double"))
        .when(o % 19 == 0, F.lit(float("nan")))
        .when(n == 0, q + 250)
        .when(n == 1, q / 1048576)
        .otherwise(q)
    )


def cells(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Three variables on a 10 x 10 grid with 0..360 longitudes, in four files."""
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("file_"), (F.col("l_orderkey") % 4).cast("string")).alias("file_id"),
        pick(["tas", "pr", "sfcWind"], F.col("l_linenumber") % 3).alias("variable"),
        F.col("l_shipdate").alias("time"),
        (whole(p % 100, 10) * 2.5 + 22.5).alias("lat"),
        ((p % 10) * 7 + 230).cast("double").alias("lon"),
        _cell_value().alias("value"),
        *more,
    )


def cells_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with variables that lack latitude, longitude or both."""
    p, s = F.col("l_partkey"), F.col("l_suppkey") % 5
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("file_"), (F.col("l_orderkey") % 4).cast("string")).alias("file_id"),
        F.col("l_orderkey").alias("row_key"),
        F.when(~s.isin(0, 2), whole(p % 100, 10) * 2.5 + 22.5).alias("lat"),
        F.when(~s.isin(1, 2), ((p % 10) * 7 + 230).cast("double")).alias("lon"),
        F.col("l_quantity").alias("value"),
    )


def file_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of fifty files: some far north, some on a border line only, some without latitude."""
    p, f = F.col("l_partkey"), F.col("l_orderkey") % 50
    lat = whole(p % 100, 10) * 2.5 + 22.5
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("file_"), f.cast("string")).alias("file_id"),
        F.when(f % 11 == 2, F.lit(None).cast("double"))
        .when(f % 7 == 1, F.lit(23.5))
        .when(f % 5 == 0, lat + 40)
        .otherwise(lat)
        .alias("lat"),
        ((p % 10) * 7 + 230).cast("double").alias("lon"),
    )


def fine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells on a grid of 1/256 by 1/16 degree, with as many latitudes and longitudes as parts and suppliers give."""
    lat = (F.col("l_partkey") * 31 % 6144) * 0.00390625 + 22.001953125  # on no border
    lon = (F.col("l_suppkey") * 37 % 1024) * 0.0625 + 232
    return table(spark, sf_dir, "lineitem").select(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis entries of fifty files: three longitude conventions, some files without a latitude axis."""
    p, f = F.col("l_partkey"), F.col("l_orderkey") % 50
    lat_idx, lon_idx = whole(p % 100, 10).cast("int"), (p % 10).cast("int")
    lat = lat_idx * 2.5 + 22.5 + F.when(f % 5 == 0, 40.0).otherwise(0.0)
    lon = F.when(f % 3 == 0, 230.0 + 7 * lon_idx).when(f % 3 == 1, 36.0 * lon_idx).otherwise(36.0 * lon_idx - 180)
    base = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("file_"), f.cast("string")).alias("file_id"),
        F.explode(
            F.array(
                F.struct(
                    F.when(f % 7 == 0, "y").otherwise("lat").alias("role"), lat_idx.alias("idx"), lat.alias("value")
                ),
                F.struct(F.lit("lon").alias("role"), lon_idx.alias("idx"), lon.alias("value")),
            )
        ).alias("a"),
    )
    return base.select("file_id", "a.*").distinct()


def status_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty files, ten of which have no axis at all."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("file_"), (F.col("o_orderkey") % 60).cast("string")).alias("file_id")
    ).distinct()


def grid_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight variables per file with names, standard names and axes in many mixtures."""
    p, z = F.col("p_partkey"), F.col("p_size")
    names = ["lat", "LAT", "latitude", "lon", "Lon", "longitude", "time", "t", "datetime", "tas", "x", "y"]
    standard = F.when(p * 7 % 11 == 0, "latitude").when(p * 7 % 11 == 1, "longitude").when(
        p * 7 % 11 == 2, "time"
    ).when(p * 7 % 11 == 3, "air_temperature")
    axis = F.when(p % 13 == 0, "T").when(p % 13 == 1, "t").when(p % 13 == 2, "X")
    attrs = F.map_filter(
        F.create_map(F.lit("standard_name"), standard, F.lit("axis"), axis), lambda _, v: v.isNotNull()
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("f"), whole(p, 8).cast("string")).alias("file_id"),
        (p % 8).cast("int").alias("var_pos"),
        pick(names, z % 12).alias("var_name"),
        pick([" K ", "K", "m/s", "degC"], p % 4).alias("units"),
        attrs.alias("attrs"),
    )


def _polygon_wkt() -> Column:
    k = F.col("s_suppkey")
    cx, cy = -122.0 + 7 * (k * 3 % 7), 25.5 + 2.5 * (k % 6)
    hw, hh = 2.0 + k % 5, 1.0 + 0.5 * (k % 3)

    def ring(*points: tuple[Column, Column]) -> Column:
        texts = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in points]
        return F.concat(F.lit("("), F.concat_ws(", ", *texts, texts[0]), F.lit(")"))

    box = ring((cx - hw, cy - hh), (cx + hw, cy - hh), (cx + hw, cy + hh), (cx - hw, cy + hh))
    triangle = ring((cx - hw, cy - hh), (cx + hw, cy - hh), (cx, cy + hh))
    diamond = ring((cx - hw, cy), (cx, cy - hh), (cx + hw, cy), (cx, cy + hh))
    hole = ring((cx - 1.25, cy - 0.75), (cx - 0.75, cy - 0.75), (cx - 0.75, cy - 0.25), (cx - 1.25, cy - 0.25))
    body = F.when(k % 4 == 1, triangle).when(k % 4 == 2, F.concat(box, F.lit(", "), hole)).when(
        k % 4 == 3, diamond
    ).otherwise(box)
    return F.concat(F.lit("POLYGON ("), body, F.lit(")"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per supplier: boxes, triangles, boxes with a hole, diamonds; many overlap."""
    shapes = table(spark, sf_dir, "supplier").select(
        F.lit("R").alias("region_id"), F.col("s_suppkey").alias("polygon_id"), _polygon_wkt().alias("wkt")
    )
    return boundary_edges(shapes, wkt_polygons(F.col("wkt")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    variable = pick(["tas", "pr", "zg"], p % 3)
    base = F.concat(variable, F.lit("_"), "p_type", F.lit("_"), F.col("p_size").cast("string"), F.lit(".nc"))
    name = F.concat(pick(["CMIP6_", "CMIP5_", "ScenarioMIP_250km_", ""], p % 4), base)
    attrs = F.create_map(
        F.lit("activity_id"),
        F.col("p_type"),
        F.lit("source_id"),
        F.col("p_brand"),
        F.lit("variant_label"),
        F.when(p % 13 == 0, "").otherwise(F.concat(F.lit("r"), (p % 3 + 1).cast("string"), F.lit("i1p1f1"))),
        F.lit("variable_id"),
        variable,
        F.lit("institution_id"),
        F.when(p % 5 != 0, F.col("p_brand")),
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), p.cast("string"), F.lit("/"), name).alias("file_id"),
        name.alias("name"),
        F.when(p % 7 != 0, F.concat(F.lit("d"), (p % 7).cast("string"))).otherwise("").alias("rel_dir"),
        F.map_filter(attrs, lambda _, v: v.isNotNull()).alias("attrs"),
        F.when(p % 11 == 0, "Read error").alias("error"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents from five nodes: most ids repeat, some come once, some are missing."""
    k = F.col("o_orderkey")
    instance = (
        F.when(k % 23 == 0, F.lit(None).cast("string"))
        .when(k % 29 == 0, F.concat(F.lit("solo."), k.cast("string")))
        .otherwise(F.concat(F.lit("ds."), (k % 500).cast("string")))
    )
    title = F.concat(instance, F.lit(".nc"))
    nodes = ["DKRZ", "CEDA", "LLNL", "IPSL", "NCI"]
    node = pick(nodes, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    service = F.when(k % 7 == 0, "OPENDAP").otherwise("HTTPServer")

    def url(path: str) -> Column:
        return F.concat(
            F.lit("https://"), F.lower(node), F.lit(f".example.org/{path}/"), title, F.lit("|application/netcdf|"), service
        )

    facets = F.create_map(
        F.lit("variable_id"),
        F.array(pick(["tas", "pr", "zg"], k % 3)),
        F.lit("source_id"),
        F.array(F.concat(F.lit("M"), (F.col("o_custkey") % 9).cast("string"))),
        F.lit("frequency"),
        F.array(F.when(F.col("o_orderstatus") == "F", "mon").when(F.col("o_orderstatus") == "O", "day").otherwise("yr")),
        F.lit("activity_id"),
        F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(["CMIP", "High/Res"], k % 2))),
        F.lit("nominal_resolution"),
        F.array(pick(["250 km", "100 km"], k % 2)),
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("arrival"),
        instance.alias("instance_id"),
        title.alias("title"),
        node.alias("data_node"),
        (k % 2 == 1).alias("replica"),
        (k % 3 != 0).alias("latest"),
        F.array(url("z"), url("a")).alias("url"),
        facets.alias("facets"),
    )


def era5_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    codes = ERA5_CODES + UNKNOWN_CODES
    start = F.date_add(F.lit("2021-01-01").cast("date"), (k * 11 % 300).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        F.concat(F.upper(pick(codes, k % len(codes))), F.lit(" (as asked)")).alias("variable"),
        start.alias("start"),
        F.date_add(start, (k % 90).cast("int")).alias("end"),
    )


def era5_list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a comma list: the variable, nothing, and the third code from it."""
    third = F.upper(pick(ERA5_CODES + UNKNOWN_CODES, (F.col("request_id") + 3) % len(ERA5_CODES + UNKNOWN_CODES)))
    return era5_requests(spark, sf_dir).withColumn("variables", F.concat(F.col("variable"), F.lit(" , ,"), third)).drop("variable")


def era5_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects over the variable map and the months of 2021, several per prefix as the table grows."""
    p = F.col("p_partkey")
    folder = pick([r[1] for r in ERA5_VARIABLES], p % len(ERA5_VARIABLES))
    code = pick([r[2] for r in ERA5_VARIABLES], p % len(ERA5_VARIABLES))
    month = F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0")
    return table(spark, sf_dir, "part").select(
        F.concat(
            folder, F.lit("/2021"), month, F.lit("/"), folder, F.lit("."), code, F.lit("."), p.cast("string"), F.lit(".nc")
        ).alias("key"),
        p.alias("size"),
    )


def prism_requests(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("2020-01-01").cast("date"), (k * 5 % 700 + shift).cast("int"))
    lists = [["ppt"], ["tmin", "tmax"], ["ppt", "tmean", "vpdmax"]]
    arrays = F.array(*[F.array(*[F.lit(v) for v in vs]) for vs in lists])
    return table(spark, sf_dir, "supplier").select(
        F.element_at(arrays, (k % 3 + 1).cast("int")).alias("variables"),
        start.alias("start"),
        F.date_add(start, (k % 40).cast("int")).alias("end"),
        k.alias("request_id"),
    )


def prism_month_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts on every day of the month, so that short months clamp."""
    r = prism_requests(spark, sf_dir)
    return r.withColumn("end", F.date_add("start", (F.col("request_id") * 13 % 400).cast("int")))


def prism_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prism_expand(prism_requests(spark, sf_dir, shift=5)).select("url")


def prism_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prism_expand(prism_requests(spark, sf_dir, shift=12)).select("output_path")


def bounds(spark: SparkSession, sf_dir: str, turned: bool = False) -> DataFrame:
    """One box per customer on quarter degrees; ``turned`` gives some with exchanged sides."""
    k = F.col("c_custkey")
    south = (k * 37 % 600) * 0.25 - 75
    west = (k * 91 % 1400) * 0.25 - 176
    less = 1 if turned else 0
    return table(spark, sf_dir, "customer").select(
        k.alias("box_id"),
        (south + (k % 5 - less) * 0.5).alias("north"),
        south.alias("south"),
        (west + (k % 4 - less) * 0.75).alias("east"),
        west.alias("west"),
    )


def usgs_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile per box, in the current folder, the historical one, or both."""
    from cellweave.constants import USGS_CURRENT, USGS_HISTORICAL
    from cellweave.functions.naming import usgs_tile

    k = F.col("box_id")
    tile = usgs_tile(F.ceil("south").cast("int"), F.floor("west").cast("int"))
    rest = F.concat(tile, F.lit("/USGS_13_"), tile, F.lit(".tif"))
    keys = F.array_compact(
        F.array(
            F.when(k % 3 != 1, F.concat(F.lit(USGS_CURRENT), rest)),
            F.when(k % 3 != 0, F.concat(F.lit(USGS_HISTORICAL), rest)),
        )
    )
    return bounds(spark, sf_dir).select(F.explode(keys).alias("key"), k.alias("size"))


def granule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One GeoJSON page text per event."""
    kind, i = F.col("event_type"), F.col("event_id").cast("string")
    properties = F.struct(
        F.when(kind != "error", F.concat(F.lit("https://data.example.org/g/"), i, F.lit(".h5"))).alias("url"),
        F.when(kind != "view", F.concat(F.lit("granule_"), i, F.lit(".h5"))).alias("fileName"),
        F.when(kind != "signup", F.col("user_id") * 10).alias("bytes"),
    )
    page = F.struct(F.array(F.struct(properties.alias("properties"))).alias("features"))
    return table(spark, sf_dir, "events").select(F.to_json(page).alias("text"))


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("granule_id"),
        (u % 180 - 90).cast("double").alias("lat"),
        (u * 7 % 360 - 180).cast("double").alias("lon"),
        F.col("ts").alias("start"),
        pick(["ASCENDING", "DESCENDING"], F.col("event_id") % 2).alias("flight_direction"),
    )


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected digests of all documents: some wrong, some missing, two types."""
    d, body = F.col("doc_id"), F.encode("text", "UTF-8")
    right = F.when(d % 2 == 0, F.md5(body)).otherwise(F.sha2(body, 256))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), d.cast("string")).alias("title"),
        F.when(d % 7 == 0, F.lit(None).cast("string"))
        .when(d % 10 == 0, F.concat(F.lit("0"), right))
        .otherwise(right)
        .alias("checksum"),
        F.when(d % 2 == 0, "MD5").otherwise("SHA256").alias("checksum_type"),
        F.col("n_chars").alias("size_bytes"),
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are at hand: those with a label."""
    at_hand = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").join(at_hand, "doc_id", "left_semi").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"),
        F.encode("text", "UTF-8").alias("content"),
    )


def written_bodies(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Forty bodies made of the documents, written as files; expected digests, some wrong, some missing."""
    g = F.col("doc_id") % 40
    body = F.array_join(F.array_sort(F.collect_list(F.sha2("text", 256))), "-")
    files = table(spark, sf_dir, "documents").groupBy(g.alias("g")).agg(body.alias("value"))
    title = F.concat(F.lit("body_"), F.col("g").cast("string")).alias("title")
    files.select(title, "value").write.partitionBy("title").option("lineSep", "#").text(root)
    written = F.concat("value", F.lit("#"))
    right = F.when(F.col("g") % 2 == 0, F.md5(written)).otherwise(F.sha2(written, 256))
    wrong = (F.col("g") % 3 == 0) | (F.col("g") % 7 == 0)
    return files.select(
        title,
        F.when(F.col("g") % 5 == 0, "").when(wrong, F.reverse(right)).otherwise(right).alias("checksum"),
        F.when(F.col("g") % 2 == 0, "MD5").otherwise("sha256").alias("checksum_type"),
    )


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a hundred documents from five nodes and seven queries: some lost, some short, some overlapping."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max(whole(k, 35)).alias("last")).scalar()
    held = {n: ",".join(["{}"] * n) for n in (60, 100, 130)}
    docs = F.when(k % 29 == 0, held[130]).when(k % 31 == 0, held[60]).otherwise(held[100])
    page = F.concat(
        F.lit('{"response": {"numFound": '), (last * 100 + 70).cast("string"), F.lit(', "start": '), (whole(k, 35) * 100).cast("string"),
        F.lit(', "docs": ['), docs, F.lit("]}}"),
    )
    return orders.where(k % 23 != 0).select(
        pick(["DKRZ", "CEDA", "LLNL", "IPSL", "NCI"], k % 5).alias("node"), F.concat(F.lit("q"), (whole(k, 5) % 7).cast("string")).alias("query"), page.alias("page")
    )


def cf_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") * 31 % 200000 - 3000 + F.col("l_quantity") * 0.25).alias("time_value"),
        pick(
            [
                "days since 2000-01-01",
                "hours since 1990-06-15 12:00:00",
                "seconds since 1970-01-01 00:00:30",
                "days since 1850-03-01T06:00",
            ],
            n,
        ).alias("units"),
        F.when(F.col("l_returnflag") == "A", "standard")
        .when(F.col("l_returnflag") == "N", "noleap")
        .otherwise("360_day")
        .alias("calendar"),
        F.col("l_shipdate").alias("day"),
    )


def cf_odd_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of centuries, in less common calendars and spellings; some axes can't be decoded."""
    k = F.col("l_linenumber") % 3
    units = ["hrs since 1-1-1 00:00 -06:00", "days since 1500-02-28T18:30Z", "msecs since 1700-03-01 00:00:10", "days since never", "weeks since 2000-01-01"]
    odd = F.when(F.col("l_suppkey") % 11 == 0, 3).when(F.col("l_suppkey") % 11 == 1, 4)
    at = F.coalesce(odd, k)
    scale = F.when(k == 0, 24).when(k == 2, 86400000).otherwise(1)
    calendar = pick(["proleptic_gregorian", "julian", "standard"], F.col("l_orderkey") % 3)
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_partkey") % 13 > 0, (F.col("l_partkey") * 31 % 200000 + F.col("l_quantity") * 0.25) * scale).alias("time_value"),
        pick(units, at).alias("units"),
        F.when(F.col("l_suppkey") % 17 == 0, "lunar").otherwise(calendar).alias("calendar"),
    )


def vocab_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        pick(["CMIP6", "CMIP5"], p % 2).alias("project"),
        F.concat(F.lit("facet_"), F.col("p_size").cast("string")).alias("facet"),
        F.when(p % 10 == 0, "{broken").otherwise(F.to_json(F.array("p_brand", "p_type", "p_name"))).alias("body"),
    )


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms for two facets; both lack values that the documents use."""
    sources = table(spark, sf_dir, "region").select(
        F.lit("source_id").alias("facet"), F.concat(F.lit("M"), F.col("r_regionkey").cast("string")).alias("term")
    )
    variables = table(spark, sf_dir, "nation").select(
        F.lit("variable_id").alias("facet"), pick(["tas", "pr"], F.col("n_nationkey") % 2).alias("term")
    )
    return sources.unionByName(variables)


# Axes of the raw files: (file, latitude variable, its dimension, its standard name, the same of the
# longitude, dimensions of tas in order, calendar). File 3 has no longitude and an odd time unit, file 4 a
# latitude in two dimensions, file 5 no time.
RAW_FILES = [
    (0, "lat", "lat", None, "lon", "lon", None, ["time", "lat", "lon"], "julian"),
    (1, "y", "y", "latitude", "x", "x", "longitude", ["x", "y", "time"], "noleap"),
    (2, "Latitude", "nlat", None, "LON", "nlon", None, ["time", "nlat", "nlon"], "360_day"),
    (3, "lat", "lat", None, "east", "east", None, ["time", "lat", "east"], "standard"),
    (4, "lat", "lat", None, "lon", "lon", None, ["time", "lat", "lon"], "standard"),
    (5, "lat", "lat", None, "lon", "lon", None, ["time", "lat", "lon"], "standard"),
]


def _raw_file(column: str) -> Column:
    return F.concat(F.lit("raw_"), F.pmod(F.col(column), F.lit(6)).cast("string"))


def raw_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the raw files."""
    rows = []
    for f, lat, lat_dim, lat_std, lon, lon_dim, lon_std, dims, calendar in RAW_FILES:
        standard = lambda s: {} if s is None else {"standard_name": s}
        found = [
            (lat, [lat_dim, "k"] if f == 4 else [lat_dim], None, "degrees", standard(lat_std)),
            (lon, [lon_dim], None, "degrees", standard(lon_std)),
            ("tas", dims, 50.0, "K", {}),
            ("zg", [*dims[:1], "plev", *dims[1:]], None, "m", {}),
            ("orog", [d for d in dims if d != "time"], None, "m", {}),
            ("height", [], None, "m", {}),
        ]
        if f != 5:
            unit = "fortnights" if f == 3 else "days"
            found.append(("time", ["time"], None, f"{unit} since 1992-01-01", {"axis": "T", "calendar": calendar}))
        if f != 2:
            found.append(("plev", ["plev"], None, "hPa", {}))
        rows += [(f"raw_{f}", k, n, "double", d, fill, units, attrs) for k, (n, d, fill, units, attrs) in enumerate(found)]
    headers = spark.createDataFrame(rows, GRID_VARS)
    files = table(spark, sf_dir, "lineitem").select(_raw_file("l_orderkey").alias("file_id")).distinct()
    return headers.join(files, "file_id", "left_semi")


def raw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the raw arrays: axes as long as the part and supplier tables make them, a cell per line item."""
    key, day = F.col("l_orderkey"), F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    at = {"time": day, "lat": whole(F.col("l_partkey"), 10).cast("int"), "lon": F.col("l_suppkey").cast("int"), "plev": F.col("l_linenumber") % 3}
    kind = pick(["tas", "zg", "orog"], F.col("l_linenumber") % 3)

    def positions(name: str) -> Column:
        out = None
        for f, _, lat_dim, _, _, lon_dim, _, dims, _ in RAW_FILES:
            along = {"tas": dims, "zg": [*dims[:1], "plev", *dims[1:]], "orog": [d for d in dims if d != "time"]}[name]
            role = {lat_dim: "lat", lon_dim: "lon", "time": "time", "plev": "plev"}
            here = F.array(*[at[role[d]].cast("int") for d in along])
            out = F.when(key % 6 == f, here) if out is None else out.when(key % 6 == f, here)
        return out

    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(
        _raw_file("l_orderkey").alias("file_id"),
        kind.alias("var_name"),
        F.when(kind == "tas", positions("tas")).when(kind == "zg", positions("zg")).otherwise(positions("orog")).alias("pos"),
        F.col("l_quantity").cast("double").alias("value"),
    )

    def axis(rows: DataFrame, name: Column, idx: Column, value: Column, files: list[int]) -> DataFrame:
        each = rows.select(F.explode(F.array(*map(F.lit, files))).alias("f"), idx.cast("int").alias("idx"), value.cast("double").alias("value"))
        return each.select(F.concat(F.lit("raw_"), F.col("f").cast("string")).alias("file_id"), name.alias("var_name"), F.array("idx").alias("pos"), "value")

    f = F.col("f")
    i = F.col("i")
    parts = table(spark, sf_dir, "part").select(whole(F.col("p_partkey"), 10).alias("i")).distinct()
    lat = axis(parts, pick([r[1] for r in RAW_FILES], f), i, i * 0.0625 - 60, [0, 1, 2, 3, 5])
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"))
    lon = axis(suppliers, pick([r[4] for r in RAW_FILES], f), i, i * 0.25, [0, 1, 2, 3, 4, 5])
    days = lines.agg(F.max(day).alias("last")).select(F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))).alias("i"))
    time = axis(days, F.lit("time"), i, i, [0, 1, 2, 3, 4])
    levels = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("i"))
    plev = axis(levels, F.lit("plev"), i, 1000 - i * 250, [0, 1, 3, 4, 5])
    scalar = raw_vars(spark, sf_dir).where("var_name = 'height'").select("file_id", "var_name", F.array().cast("array<int>").alias("pos"), F.lit(2.0).alias("value"))
    return cells.union(lat).union(lon).union(time).union(plev).union(scalar)
