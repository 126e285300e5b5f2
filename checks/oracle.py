"""SQL for DuckDB that gives the result of each registered query from the same tables.

Written independently of the Spark operators: points are paired with all edges, chained months are a
recursive query, calendars come from generated day tables, and so on.
"""

from __future__ import annotations

import re

from cellweave.constants import (
    AREAS_OF_INTEREST,
    COP30_BUCKET,
    COP30_REGION,
    ERA5_VARIABLES,
    PRISM_BASE_URL,
    USGS_BUCKET,
    USGS_CURRENT,
    USGS_HISTORICAL,
    USGS_REGION,
)
from checks.views import ERA5_CODES, UNKNOWN_CODES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_quote(x) for x in values) + "]"


def _era5_values() -> str:
    rows, parts = [], {}
    for i, (code, folder, file_code, descr) in enumerate(ERA5_VARIABLES):
        parts[code] = parts.get(code, -1) + 1
        rows.append(f"({i}, {_quote(code)}, {parts[code]}, {_quote(folder)}, {_quote(file_code)}, {_quote(descr)})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(row_no, code, part, folder, file_code, descr)"


_N = len(ERA5_VARIABLES)
_LON = "CASE WHEN lon > 180 THEN lon - 360 ELSE lon END"
_CX, _CY = "(-122.0 + 7 * (s_suppkey * 3 % 7))", "(25.5 + 2.5 * (s_suppkey % 6))"
_HW, _HH = "(2.0 + s_suppkey % 5)", "(1.0 + 0.5 * (s_suppkey % 3))"
_E2 = "(2/298.257223563 - 1/(298.257223563*298.257223563))"
_K0 = f"(cos(radians(30)) / sqrt(1 - {_E2} * sin(radians(30)) * sin(radians(30))))"


def _ex(lon: str) -> str:
    return f"(6378137.0 * {_K0} * radians({lon}))"


def _ey(lat: str) -> str:
    s, e = f"sin(radians({lat}))", f"sqrt({_E2})"
    q = f"((1 - {_E2}) * ({s} / (1 - {_E2}*{s}*{s}) - (1/(2*{e})) * ln((1 - {e}*{s}) / (1 + {e}*{s}))))"
    return f"(6378137.0 * {q} / (2 * {_K0}))"


def _prism(requests: str, resolution: str, code: str, step: str, fmt: str) -> str:
    name = f"'prism_' || variable || '_us_{code}_' || strftime(date, '{fmt}') || '.zip'"
    return f"""
      SELECT request_id, variable, CAST(CAST(date AS DATE) AS VARCHAR) AS date, {name} AS filename,
             '{PRISM_BASE_URL}/{resolution}/' || variable || '/{step}/' || strftime(date, '%Y') || '/' || {name} AS url,
             variable || '/{resolution}/' || {name} AS output_path
      FROM (SELECT request_id, date, unnest(variables) AS variable FROM {requests})"""


def _prism_requests(shift: int) -> str:
    return f"""
      SELECT s_suppkey AS request_id, start_day, start_day + CAST(s_suppkey % 40 AS INTEGER) AS end_day, variables
      FROM (SELECT s_suppkey, DATE '2020-01-01' + CAST(s_suppkey * 5 % 700 + {shift} AS INTEGER) AS start_day,
                   CASE s_suppkey % 3 WHEN 0 THEN ['ppt'] WHEN 1 THEN ['tmin', 'tmax'] ELSE ['ppt', 'tmean', 'vpdmax'] END
                     AS variables
            FROM supplier)"""


def _daily(requests: str) -> str:
    return f"""SELECT request_id, variables, unnest(generate_series(start_day, end_day, INTERVAL 1 DAY)) AS date
      FROM {requests}"""


_CTE = {
    "v_cells": """
      SELECT 'file_' || (l_orderkey % 4) AS file_id, l_shipdate AS time,
             CASE l_linenumber % 3 WHEN 0 THEN 'tas' WHEN 1 THEN 'pr' ELSE 'sfcWind' END AS variable,
             CAST(22.5 + 2.5 * (l_partkey % 100 // 10) AS DOUBLE) AS lat,
             CAST(230 + 7 * (l_partkey % 10) AS DOUBLE) AS lon,
             CASE WHEN l_orderkey % 17 = 0 THEN NULL
                  WHEN l_orderkey % 19 = 0 THEN CAST('NaN' AS DOUBLE)
                  WHEN l_linenumber % 3 = 0 THEN 250 + l_quantity
                  WHEN l_linenumber % 3 = 1 THEN l_quantity / 1048576
                  ELSE l_quantity END AS value
      FROM lineitem""",
    "v_file_points": """
      SELECT 'file_' || f AS file_id, CAST(230 + 7 * (l_partkey % 10) AS DOUBLE) AS lon,
             CAST(CASE WHEN f % 11 = 2 THEN NULL WHEN f % 7 = 1 THEN 23.5
                       WHEN f % 5 = 0 THEN 62.5 + 2.5 * (l_partkey % 100 // 10)
                       ELSE 22.5 + 2.5 * (l_partkey % 100 // 10) END AS DOUBLE) AS lat
      FROM (SELECT *, l_orderkey % 50 AS f FROM lineitem)""",
    "v_coords": """
      SELECT DISTINCT 'file_' || f AS file_id, CASE WHEN f % 7 = 0 THEN 'y' ELSE 'lat' END AS role,
             CAST(l_partkey % 100 // 10 AS INTEGER) AS idx,
             CAST(22.5 + 2.5 * (l_partkey % 100 // 10) + CASE WHEN f % 5 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS value
      FROM (SELECT *, l_orderkey % 50 AS f FROM lineitem)
      UNION
      SELECT DISTINCT 'file_' || f, 'lon', CAST(l_partkey % 10 AS INTEGER),
             CAST(CASE f % 3 WHEN 0 THEN 230 + 7 * (l_partkey % 10) WHEN 1 THEN 36 * (l_partkey % 10)
                             ELSE 36 * (l_partkey % 10) - 180 END AS DOUBLE)
      FROM (SELECT *, l_orderkey % 50 AS f FROM lineitem)""",
    "v_status_files": "SELECT DISTINCT 'file_' || (o_orderkey % 60) AS file_id FROM orders",
    "v_windows": """
      SELECT f.file_id,
             count(*) FILTER (role = 'lat') AS lat_size, count(*) FILTER (role = 'lon') AS lon_size,
             count(*) FILTER (role = 'lat' AND value BETWEEN 25 AND 50) AS lat_count,
             count(*) FILTER (role = 'lon' AND n BETWEEN -60 AND 60) AS lon_count,
             max(idx) FILTER (role = 'lat' AND value BETWEEN 25 AND 50)
               - min(idx) FILTER (role = 'lat' AND value BETWEEN 25 AND 50) + 1 AS lat_span,
             max(idx) FILTER (role = 'lon' AND n BETWEEN -60 AND 60)
               - min(idx) FILTER (role = 'lon' AND n BETWEEN -60 AND 60) + 1 AS lon_span
      FROM v_status_files f
      LEFT JOIN (SELECT *, CASE WHEN value > 180 THEN value - 360 ELSE value END AS n FROM v_coords) c
        ON f.file_id = c.file_id
      GROUP BY f.file_id""",
    "v_vars": """
      SELECT 'f' || (p_partkey // 8) AS file_id, CAST(p_partkey % 8 AS INTEGER) AS var_pos,
             ['lat', 'LAT', 'latitude', 'lon', 'Lon', 'longitude', 'time', 't', 'datetime', 'tas', 'x', 'y'][p_size % 12 + 1]
               AS var_name,
             [' K ', 'K', 'm/s', 'degC'][p_partkey % 4 + 1] AS units,
             CASE p_partkey * 7 % 11 WHEN 0 THEN 'latitude' WHEN 1 THEN 'longitude' WHEN 2 THEN 'time'
                                     WHEN 3 THEN 'air_temperature' END AS standard_name,
             CASE p_partkey % 13 WHEN 0 THEN 'T' WHEN 1 THEN 't' WHEN 2 THEN 'X' END AS axis
      FROM part""",
    "v_var_files": "SELECT DISTINCT file_id FROM v_vars",
    "v_rings": f"""
      SELECT s_suppkey AS polygon_id, 0 AS ring_id,
             CASE s_suppkey % 4 WHEN 1 THEN [{_CX} - {_HW}, {_CX} + {_HW}, {_CX}]
                                WHEN 3 THEN [{_CX} - {_HW}, {_CX}, {_CX} + {_HW}, {_CX}]
                                ELSE [{_CX} - {_HW}, {_CX} + {_HW}, {_CX} + {_HW}, {_CX} - {_HW}] END AS xs,
             CASE s_suppkey % 4 WHEN 1 THEN [{_CY} - {_HH}, {_CY} - {_HH}, {_CY} + {_HH}]
                                WHEN 3 THEN [{_CY}, {_CY} - {_HH}, {_CY}, {_CY} + {_HH}]
                                ELSE [{_CY} - {_HH}, {_CY} - {_HH}, {_CY} + {_HH}, {_CY} + {_HH}] END AS ys
      FROM supplier
      UNION ALL
      SELECT s_suppkey, 1, [{_CX} - 1.25, {_CX} - 0.75, {_CX} - 0.75, {_CX} - 1.25],
             [{_CY} - 0.75, {_CY} - 0.75, {_CY} - 0.25, {_CY} - 0.25]
      FROM supplier WHERE s_suppkey % 4 = 2""",
    # A closed ring repeats its first vertex; the last, empty edge does not count.
    "v_edges": """
      SELECT polygon_id, ring_id, CAST(i AS INTEGER) AS seg, CAST(xs[i + 1] AS DOUBLE) AS x1, CAST(ys[i + 1] AS DOUBLE) AS y1,
             CAST(xs[(i + 1) % len(xs) + 1] AS DOUBLE) AS x2, CAST(ys[(i + 1) % len(xs) + 1] AS DOUBLE) AS y2
      FROM (SELECT *, unnest(range(len(xs))) AS i FROM v_rings)""",
    "v_points": f"SELECT DISTINCT lat, {_LON} AS lon FROM v_cells",
    "v_all_points": f"SELECT DISTINCT lat, {_LON} AS lon FROM v_file_points WHERE lat IS NOT NULL",
    "v_inside": "{inside:v_points}",
    "v_fine_points": """
      SELECT DISTINCT CAST((l_partkey * 31 % 6144) * 0.00390625 + 22.001953125 AS DOUBLE) AS lat, CAST((l_suppkey * 37 % 1024) * 0.0625 - 128 AS DOUBLE) AS lon FROM lineitem""",
    "v_fine_inside": "{inside:v_fine_points}",
    "v_all_inside": "{inside:v_all_points}",
    "v_files": """
      SELECT 'd' || p_partkey || '/' || name AS file_id, name, base, rel_dir, variable_id, activity_id, source_id,
             variant_label, institution_id, error
      FROM (SELECT p_partkey, ['CMIP6_', 'CMIP5_', 'ScenarioMIP_250km_', ''][p_partkey % 4 + 1] || base AS name, * EXCLUDE (p_partkey)
            FROM (SELECT p_partkey, v || '_' || p_type || '_' || p_size || '.nc' AS base, v AS variable_id,
                         p_type AS activity_id, p_brand AS source_id,
                         CASE WHEN p_partkey % 7 <> 0 THEN 'd' || (p_partkey % 7) ELSE '' END AS rel_dir,
                         CASE WHEN p_partkey % 13 = 0 THEN '' ELSE 'r' || (p_partkey % 3 + 1) || 'i1p1f1' END AS variant_label,
                         CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS institution_id,
                         CASE WHEN p_partkey % 11 = 0 THEN 'Read error' END AS error
                  FROM (SELECT *, ['tas', 'pr', 'zg'][p_partkey % 3 + 1] AS v FROM part)))""",
    "v_ranked_files": """
      SELECT *, row_number() OVER (PARTITION BY base
                 ORDER BY CASE WHEN regexp_matches(name, '^(tas|pr|huss|psl|ts|uas|vas)_') THEN 0 ELSE 1 END, file_id) AS rn,
             count(*) OVER (PARTITION BY base) AS copies
      FROM v_files""",
    "v_kept": "SELECT * FROM v_ranked_files WHERE rn = 1",
    "v_entries": """
      SELECT *, activity_id || ':' || source_id || ':' || variant_label AS catalog_key
      FROM v_kept WHERE error IS NULL AND activity_id <> '' AND source_id <> '' AND variant_label <> '' AND variable_id <> ''""",
    "v_catalog": """
      SELECT e.catalog_key, i.institution_id, e.variable_id, e.file_id,
             count(*) OVER (PARTITION BY e.catalog_key, e.variable_id) AS file_count
      FROM v_entries e
      JOIN (SELECT catalog_key, institution_id FROM
              (SELECT *, row_number() OVER (PARTITION BY catalog_key ORDER BY file_id) AS k FROM v_entries) WHERE k = 1) i
        ON e.catalog_key = i.catalog_key""",
    "v_docs": """
      SELECT arrival, instance_id, instance_id || '.nc' AS title, node AS data_node, replica, latest,
             'https://' || lower(node) || '.example.org/z/' || instance_id || '.nc|application/netcdf|' || service AS url_z,
             'https://' || lower(node) || '.example.org/a/' || instance_id || '.nc|application/netcdf|' || service AS url_a,
             service, variable_id, source_id, frequency, activity_id, resolution
      FROM (SELECT o_orderkey AS arrival, o_orderkey % 2 = 1 AS replica, o_orderkey % 3 <> 0 AS latest,
                   CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'solo.' || o_orderkey
                        ELSE 'ds.' || (o_orderkey % 500) END AS instance_id,
                   ['DKRZ', 'CEDA', 'LLNL', 'IPSL', 'NCI'][CAST(o_orderpriority[1] AS INTEGER)] AS node,
                   CASE WHEN o_orderkey % 7 = 0 THEN 'OPENDAP' ELSE 'HTTPServer' END AS service,
                   ['tas', 'pr', 'zg'][o_orderkey % 3 + 1] AS variable_id, 'M' || (o_custkey % 9) AS source_id,
                   CASE o_orderstatus WHEN 'F' THEN 'mon' WHEN 'O' THEN 'day' ELSE 'yr' END AS frequency,
                   CASE WHEN o_orderkey % 6 <> 0 THEN ['CMIP', 'High/Res'][o_orderkey % 2 + 1] END AS activity_id,
                   ['250 km', '100 km'][o_orderkey % 2 + 1] AS resolution
            FROM orders)""",
    "v_era5": _era5_values(),
    "v_era5_requests": f"""
      SELECT c_custkey AS request_id, {_list(ERA5_CODES + UNKNOWN_CODES)}[c_custkey % {len(ERA5_CODES + UNKNOWN_CODES)} + 1] AS code,
             DATE '2021-01-01' + CAST(c_custkey * 11 % 300 AS INTEGER) AS start_day,
             DATE '2021-01-01' + CAST(c_custkey * 11 % 300 + c_custkey % 90 AS INTEGER) AS end_day
      FROM customer""",
    "v_era5_expected": """
      SELECT request_id, code AS variable, part, descr AS description, CAST(year(m) AS INTEGER) AS year,
             CAST(month(m) AS INTEGER) AS month, folder || '/' || strftime(m, '%Y%m') || '/' || folder || '.' || file_code || '.' AS prefix
      FROM (SELECT request_id, v.*, unnest(generate_series(date_trunc('month', start_day), CAST(end_day AS TIMESTAMP), INTERVAL 1 MONTH)) AS m
            FROM v_era5_requests r JOIN v_era5 v ON lower(r.code) = v.code)""",
    "v_era5_listing": f"""
      SELECT folder || '/2021' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '/' || folder || '.' || file_code || '.' || p_partkey || '.nc' AS key,
             p_partkey AS size
      FROM part JOIN v_era5 ON p_partkey % {_N} = row_no""",
    "v_prism_days": _daily("(" + _prism_requests(0) + ")"),
    "v_prism_days5": _daily("(" + _prism_requests(5) + ")"),
    "v_prism_days12": _daily("(" + _prism_requests(12) + ")"),
    "v_prism": _prism("v_prism_days", "4km", "25m", "daily", "%Y%m%d"),
    "v_prism_listing": _prism("v_prism_days5", "4km", "25m", "daily", "%Y%m%d"),
    "v_prism_existing": _prism("v_prism_days12", "4km", "25m", "daily", "%Y%m%d"),
    "v_prism_fine": _prism("v_prism_days", "800m", "30s", "daily", "%Y%m%d"),
    "v_bounds": """
      SELECT c_custkey AS box_id, south + (c_custkey % 5) * 0.5 AS north, south, west + (c_custkey % 4) * 0.75 AS east, west
      FROM (SELECT c_custkey, (c_custkey * 37 % 600) * 0.25 - 75 AS south, (c_custkey * 91 % 1400) * 0.25 - 176 AS west FROM customer)""",
    "v_cop30": f"""
      SELECT box_id, base || '.tif' AS filename, base || '/' || base || '.tif' AS key,
             '{COP30_BUCKET}' AS bucket, '{COP30_REGION}' AS region
      FROM (SELECT box_id, 'Copernicus_DSM_COG_10_' || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || printf('%02d', abs(lat))
                   || '_00_' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || printf('%03d', abs(lon)) || '_00_DEM' AS base
            FROM (SELECT box_id, lat, unnest(range(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT) + 1)) AS lon
                  FROM (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(floor(north) AS BIGINT) + 1)) AS lat FROM v_bounds)))""",
    "v_usgs": f"""
      SELECT box_id, tile_id, 'USGS_13_' || tile_id || '.tif' AS filename, '{USGS_BUCKET}' AS bucket, '{USGS_REGION}' AS region
      FROM (SELECT box_id, printf('n%02d', lat) || printf('w%03d', abs(lon)) AS tile_id
            FROM (SELECT box_id, lat, unnest(range(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT) + 1)) AS lon
                  FROM (SELECT *, unnest(range(CAST(ceil(south) AS BIGINT), CAST(ceil(north) AS BIGINT) + 1)) AS lat FROM v_bounds)))""",
    "v_usgs_listing": f"""
      SELECT folder || tile || '/USGS_13_' || tile || '.tif' AS key, folder, tile, box_id AS size
      FROM (SELECT box_id, printf('n%02d', CAST(ceil(south) AS BIGINT)) || printf('w%03d', abs(CAST(floor(west) AS BIGINT))) AS tile,
                   unnest(CASE box_id % 3 WHEN 0 THEN ['{USGS_CURRENT}'] WHEN 1 THEN ['{USGS_HISTORICAL}']
                               ELSE ['{USGS_CURRENT}', '{USGS_HISTORICAL}'] END) AS folder
            FROM v_bounds)""",
    "v_verified": """
      SELECT 'doc_' || d.doc_id AS title, n_chars AS size_bytes,
             CASE WHEN d.doc_id % 7 = 0 THEN TRUE
                  WHEN d.doc_id NOT IN (SELECT doc_id FROM labels) THEN FALSE
                  ELSE d.doc_id % 10 <> 0 END AS ok
      FROM documents d""",
    "v_cf": """
      SELECT l_partkey * 31 % 200000 - 3000 + l_quantity * 0.25 AS time_value, l_linenumber % 4 AS u,
             ['days since 2000-01-01', 'hours since 1990-06-15 12:00:00', 'seconds since 1970-01-01 00:00:30',
              'days since 1850-03-01T06:00'][l_linenumber % 4 + 1] AS units,
             CASE l_returnflag WHEN 'A' THEN 'standard' WHEN 'N' THEN 'noleap' ELSE '360_day' END AS calendar,
             [86400, 3600, 1, 86400][l_linenumber % 4 + 1] AS unit_seconds,
             [0, 43200, 30, 21600][l_linenumber % 4 + 1] AS origin_seconds,
             [DATE '2000-01-01', DATE '1990-06-15', DATE '1970-01-01', DATE '1850-03-01'][l_linenumber % 4 + 1] AS origin,
             l_shipdate AS day
      FROM lineitem""",
    # Day of year in a year without a leap day, from a generated year.
    "v_noleap": """
      SELECT CAST(dayofyear(d) AS INTEGER) - 1 AS doy, CAST(month(d) AS INTEGER) AS m, CAST(day(d) AS INTEGER) AS d
      FROM (SELECT unnest(generate_series(DATE '2001-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d)""",
}


def _inside(points: str) -> str:
    return f"""
      SELECT DISTINCT lat, lon FROM (
        SELECT p.lat, p.lon, e.polygon_id,
               sum(CASE WHEN (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1
                        THEN 1 ELSE 0 END) AS crossings,
               bool_or((e.x2 - e.x1) * (p.lat - e.y1) = (p.lon - e.x1) * (e.y2 - e.y1)
                       AND p.lon BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                       AND p.lat BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS on_edge
        FROM {points} p, v_edges e GROUP BY ALL)
      WHERE crossings % 2 = 1 AND NOT on_edge"""


_CTE["v_inside"] = _inside("v_points")
_CTE["v_all_inside"] = _inside("v_all_points")
_CTE["v_fine_inside"] = _inside("v_fine_points")


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in re.findall(r"\bv_\w+", text):
        if name in _CTE and name not in seen:
            _needed(_CTE[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(body: str, recursive: str = "") -> str:
    """Prefix the views that ``body`` names, in order of dependence."""
    ctes = [f"{name} AS ({_CTE[name]})" for name in _needed(body + recursive, [])]
    if recursive:
        ctes.append(recursive)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body


SQL: dict[str, str] = {}


def add(name: str, body: str, recursive: str = "") -> None:
    SQL[name] = with_views(body, recursive)


_STATE = "CASE WHEN value IS NULL THEN 'masked' WHEN isnan(value) THEN 'nan' ELSE 'ok' END AS state"
_TIME = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"


def _value(expr: str = "value", scale: str = "CASE WHEN variable = 'pr' THEN 1048576.0 ELSE 1.0 END") -> str:
    return f"CASE WHEN NOT isnan({expr}) THEN round({expr} * {scale}, 6) END AS value"


# sources and sinks
add("grid_scan", f"SELECT file_id, {_TIME}, lat, lon, {_STATE}, {_value(scale='1.0')} FROM v_cells WHERE variable = 'tas'")
_ATTRS = ["activity_id", "source_id", "variant_label", "variable_id", "institution_id"]
add(
    "attr_scan",
    "SELECT file_id, name, error, "
    + ", ".join(f"CASE WHEN error IS NULL THEN {a} END AS {a}" for a in _ATTRS)
    + " FROM v_files",
)
add("boundary_edges", "SELECT * FROM v_edges")
add(
    "manifest_read",
    "SELECT 'doc_' || doc_id AS title, 'https://host.example.org/doc_' || doc_id AS url, n_chars AS size_bytes FROM documents",
)
add(
    "vocab_terms",
    """SELECT ['CMIP6', 'CMIP5'][p_partkey % 2 + 1] AS project, 'facet_' || p_size AS facet,
              unnest([p_brand, p_type, p_name]) AS term
       FROM part WHERE p_partkey % 10 <> 0""",
)
add(
    "search_docs",
    "SELECT instance_id, title, data_node, replica, concat_ws(' ', url_z, url_a) AS urls FROM v_docs",
)
add(
    "granule_features",
    """SELECT CASE WHEN event_type = 'view' THEN event_id || '.h5' ELSE 'granule_' || event_id || '.h5' END AS title,
              'https://data.example.org/g/' || event_id || '.h5' AS url, 'ASF_DAAC' AS source,
              CASE WHEN event_type = 'signup' THEN 0 ELSE user_id * 10 END AS size_bytes
       FROM events WHERE event_type <> 'error'""",
)
add("object_listing", "SELECT key, size FROM v_era5_listing")
_DIR = "CASE WHEN rel_dir <> '' THEN rel_dir || '/' ELSE '' END"
_STEM = "left(name, length(name) - 3)"
add(
    "output_names",
    f"""SELECT file_id, {_STEM} || '_cropped.nc' AS cropped, {_DIR} || {_STEM} || '_clipped.nc' AS clipped,
               {_DIR} || {_STEM} || '_converted.nc' AS converted, {_STEM} || '_monthly_mean.nc' AS aggregated
        FROM v_files""",
)
add("catalog_json", "SELECT * FROM v_catalog")
add("catalog_nested", "SELECT * FROM v_catalog")
add("catalog_build", "SELECT * FROM v_catalog")
add("catalog_duplicates", "SELECT file_id, base FROM v_ranked_files WHERE rn > 1")
add(
    "manifest_split",
    "SELECT title, size_bytes, CASE WHEN ok THEN 'done' ELSE 'failed' END AS list FROM v_verified",
)
_CROP_MESSAGE = """CASE WHEN lat_size = 0 OR lon_size = 0 THEN 'Missing coordinate variables'
       WHEN lat_count = 0 OR lon_count = 0 THEN 'No data in bounds' {extra} ELSE 'ok' END"""
_PLAIN_MESSAGE = _CROP_MESSAGE.format(extra="")
add(
    "run_summary",
    f"""SELECT CASE WHEN error IS NULL AND variant_label <> '' THEN 'included' ELSE 'skipped' END AS status, count(*) AS files
        FROM v_kept GROUP BY 1
        UNION ALL SELECT 'duplicate', count(*) FROM v_ranked_files WHERE rn > 1
        UNION ALL SELECT 'crop succeeded', count(*) FROM v_windows WHERE {_PLAIN_MESSAGE} = 'ok'
        UNION ALL SELECT 'crop failed', count(*) FROM v_windows WHERE {_PLAIN_MESSAGE} <> 'ok'
        UNION ALL SELECT 'crop total', count(*) FROM v_windows""",
)
add(
    "era5_list_variables",
    """SELECT code, CASE WHEN count(*) > 1 THEN '[Composite] ' ELSE '' END || string_agg(descr, ' & ' ORDER BY part) AS description,
              string_agg(file_code, ' + ' ORDER BY part) AS file_code, any_value(requests) AS requests
       FROM v_era5 JOIN (SELECT lower(code) AS code, count(*) AS requests FROM v_era5_requests GROUP BY 1) USING (code) GROUP BY code""",
)
add(
    "run_summary_written",
    """SELECT CASE WHEN error IS NULL AND variant_label <> '' THEN 'included' ELSE 'skipped' END AS status, count(*) AS files FROM v_kept GROUP BY 1
       UNION ALL SELECT 'duplicate', count(*) FROM v_ranked_files WHERE rn > 1
       UNION ALL SELECT 'written', count(*) FROM v_kept WHERE error IS NULL AND variant_label <> ''""",
)
add(
    "grid_sink",
    f"""SELECT file_id, variable, {_TIME}, lat, lon, {_STATE}, {_value()},
               CASE WHEN file_id = 'file_0' THEN '' ELSE 'run' || right(file_id, 1) || '/' END || file_id || '.v1_cropped.nc' AS output FROM v_cells""",
)

# cells of raw arrays, computed without axes
_RAW_FOUND = {"crop": (0, 1, 2, 5), "clip": (0, 1, 5)}


def _raw_cells(rule: str) -> str:
    return f"""
        SELECT 'raw_' || f AS file_id, variable, y AS year, m AS month, d AS day,
               CASE WHEN plain THEN NULL ELSE lat END AS lat, CASE WHEN plain THEN NULL ELSE lon END AS lon, levels, value FROM (
          SELECT f, variable, levels, lat, lon, value, false AS plain,
                 CASE WHEN f = 5 OR variable = 'orog' THEN NULL WHEN f = 0 THEN year(l_shipdate) WHEN f = 1 THEN 1992 + i // 365 ELSE 1992 + i // 360 END AS y,
                 CASE WHEN f = 5 OR variable = 'orog' THEN NULL WHEN f = 0 THEN month(l_shipdate)
                      WHEN f = 1 THEN month(DATE '1993-01-01' + CAST(i % 365 AS INTEGER)) ELSE i % 360 // 30 + 1 END AS m,
                 CASE WHEN f = 5 OR variable = 'orog' THEN NULL WHEN f = 0 THEN day(l_shipdate)
                      WHEN f = 1 THEN day(DATE '1993-01-01' + CAST(i % 365 AS INTEGER)) ELSE i % 30 + 1 END AS d
          FROM (SELECT l_orderkey % 6 AS f, ['tas', 'zg', 'orog'][l_linenumber % 3 + 1] AS variable, l_shipdate,
                       date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS i,
                       CAST((l_partkey // 10) * 0.0625 - 60 AS DOUBLE) AS lat, CAST(l_suppkey * 0.25 AS DOUBLE) AS lon,
                       CASE WHEN l_linenumber % 3 = 1 THEN 'plev=' || CASE WHEN l_orderkey % 6 = 2 THEN l_linenumber % 3 ELSE 1000 - 250 * (l_linenumber % 3) END
                            ELSE '' END || CASE WHEN l_orderkey % 6 = 5 AND l_linenumber % 3 < 2 THEN '#' ELSE '' END AS marked,
                       CASE WHEN l_orderkey % 6 = 5 AND l_linenumber % 3 < 2
                            THEN 'time=' || date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) || CASE WHEN l_linenumber % 3 = 1 THEN ',' ELSE '' END ELSE '' END
                         || replace(marked, '#', '') AS levels,
                       CASE WHEN l_linenumber % 3 = 0 AND l_quantity = 50 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS value
                FROM lineitem)
          UNION ALL
          SELECT DISTINCT l_orderkey % 6, 'height', '', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(2 AS DOUBLE), true, NULL, NULL, NULL FROM lineitem)
        WHERE f IN {_RAW_FOUND[rule]}"""


for _rule, _name in (("crop", "cells_from_axes"), ("clip", "cells_from_axes_clip")):
    add(_name, f"SELECT *, CASE WHEN value IS NULL THEN 'masked' ELSE 'ok' END AS state FROM ({_raw_cells(_rule)})")
add(
    "axes_status",
    """SELECT 'raw_' || f AS file_id, rule, message = 'ok' AS ok, message FROM (
         SELECT *, CASE WHEN f = 3 OR (f = 2 AND rule = 'clip') THEN CASE rule WHEN 'crop' THEN 'Missing coordinate variables' ELSE 'No coordinates found' END
                        WHEN f = 4 THEN 'Coordinate variables are not one-dimensional' ELSE 'ok' END AS message
         FROM (SELECT DISTINCT l_orderkey % 6 AS f FROM lineitem), (VALUES ('crop'), ('clip')) AS r(rule))""",
)
add(
    "agg_from_axes",
    f"""SELECT file_id, variable, lat, lon, levels, lpad(CAST(year AS VARCHAR), 4, '0') || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
               CASE WHEN count(value) = 0 THEN 'masked' ELSE 'ok' END AS state, round(avg(value), 6) AS value
        FROM ({_raw_cells('crop')}) WHERE year IS NOT NULL AND (lat IS NULL OR lat BETWEEN -59.5 AND 20)
          AND (lon IS NULL OR CASE WHEN lon > 180 THEN lon - 360 ELSE lon END BETWEEN -170 AND 170)
        GROUP BY file_id, variable, lat, lon, levels, year, month""",
)

# the files' own time axes after aggregation
def _own_axis(variable: str, period: str, reduce: str, year: str, month: str, freq: str, method: str) -> str:
    return f"""
        SELECT file_id, variable, lat, lon, levels, period, units, calendar, aggregation_details, state, value,
               CAST(CASE file_id WHEN 'raw_0' THEN date_diff('day', DATE '1992-01-01', make_date({year}, {month}, 15))
                    WHEN 'raw_1' THEN ({year} - 1992) * 365 + date_diff('day', DATE '1993-01-01', make_date(1993, {month}, 15))
                    ELSE ({year} - 1992) * 360 + ({month} - 1) * 30 + 14 END AS DOUBLE) AS time_value
        FROM (SELECT file_id, variable, lat, lon, levels, {period} AS period, 'days since 1992-01-01' AS units,
                     CASE file_id WHEN 'raw_0' THEN 'julian' WHEN 'raw_1' THEN 'noleap' ELSE '360_day' END AS calendar,
                     'Method: {method}, Frequency: {freq}' AS aggregation_details,
                     CASE WHEN count(value) = 0 THEN 'masked' ELSE 'ok' END AS state, round({reduce}(value), 6) AS value
              FROM ({_raw_cells('crop')}) WHERE year IS NOT NULL AND variable = '{variable}' GROUP BY ALL)"""


add(
    "agg_monthly_axis",
    _own_axis("tas", "lpad(CAST(year AS VARCHAR), 4, '0') || '-' || lpad(CAST(month AS VARCHAR), 2, '0')", "avg",
              "CAST(left(period, 4) AS BIGINT)", "CAST(right(period, 2) AS BIGINT)", "monthly", "mean"),
)
add(
    "agg_seasonal_axis",
    _own_axis("zg", "CAST(CASE WHEN month > 2 THEN year ELSE year - 1 END AS VARCHAR) || '-S' || CAST((month % 12 + 3) // 3 AS VARCHAR)", "median",
              "CAST(left(period, 4) AS BIGINT)", "[2, 5, 8, 11][CAST(right(period, 1) AS INTEGER)]", "seasonal", "median"),
)
add(
    "aggregate_status",
    """SELECT 'raw_' || f AS file_id, asked, message = 'ok' AS ok, message FROM (
         SELECT f, asked, CASE WHEN f = 5 OR asked = 'nlat annual sum'
                               THEN 'Required time or variable ''' || split_part(asked, ' ', 1) || ''' not found'
                               WHEN f = 3 THEN 'Unknown time unit' WHEN asked = 'zg weekly mean' THEN 'Unsupported frequency ''weekly'''
                               WHEN asked = 'zg annual mode' THEN 'Unsupported method ''mode''' ELSE 'ok' END AS message
         FROM (SELECT DISTINCT l_orderkey % 6 AS f FROM lineitem),
              (VALUES ('tas monthly mean'), ('nlat annual sum'), ('zg weekly mean'), ('zg annual mode')) AS a(asked))""",
)

# coordinates and crop
_CROP_LAT = "CASE WHEN standard_name IS NOT NULL THEN standard_name = 'latitude' ELSE lower(var_name) IN ('lat', 'latitude') END"
_CROP_LON = "CASE WHEN standard_name IS NOT NULL THEN standard_name = 'longitude' ELSE lower(var_name) IN ('lon', 'longitude') END"
_CLIP_LAT = "(coalesce(standard_name, '') = 'latitude' OR var_name IN ('lat', 'latitude'))"
_CLIP_LON = "(coalesce(standard_name, '') = 'longitude' OR var_name IN ('lon', 'longitude'))"


def _chosen(test: str, order: str) -> str:
    return f"(SELECT var_name FROM v_vars v WHERE v.file_id = f.file_id AND {test} ORDER BY {order} LIMIT 1)"


add(
    "coord_resolve_crop",
    f"""SELECT f.file_id, {_chosen(_CROP_LAT, 'var_pos DESC')} AS lat_var, {_chosen(_CROP_LON, 'var_pos DESC')} AS lon_var
        FROM v_var_files f""",
)
add(
    "coord_resolve_clip",
    f"SELECT f.file_id, {_chosen(_CLIP_LAT, 'var_pos')} AS lat_var, {_chosen(_CLIP_LON, 'var_pos')} AS lon_var FROM v_var_files f",
)
add(
    "time_resolve",
    f"""SELECT f.file_id, coalesce(
          {_chosen("(lower(axis) = 't' OR standard_name = 'time')", 'var_pos')},
          {_chosen("var_name = 'time'", 'var_pos')}, {_chosen("var_name = 't'", 'var_pos')},
          {_chosen("var_name = 'datetime'", 'var_pos')}) AS time_var
        FROM v_var_files f""",
)
add(
    "lon_normalize",
    "SELECT file_id, idx, value, CASE WHEN value > 180 THEN value - 360 ELSE value END AS lon FROM v_coords WHERE role = 'lon'",
)
_DEMO = f"lat BETWEEN 25 AND 50 AND {_LON} BETWEEN -125 AND -65"
add("crop_bbox", f"SELECT file_id, variable, {_TIME}, lat, lon, {_STATE}, {_value()} FROM v_cells WHERE {_DEMO}")
add(
    "crop_passthrough",
    f"""SELECT * FROM (
          SELECT 'file_' || (l_orderkey % 4) AS file_id, l_orderkey AS row_key, l_quantity AS value,
                 CASE WHEN l_suppkey % 5 NOT IN (0, 2) THEN CAST(22.5 + 2.5 * (l_partkey % 100 // 10) AS DOUBLE) END AS lat,
                 CASE WHEN l_suppkey % 5 NOT IN (1, 2) THEN CAST(230 + 7 * (l_partkey % 10) AS DOUBLE) END AS lon
          FROM lineitem)
        WHERE (lat IS NULL OR lat BETWEEN 25 AND 50) AND (lon IS NULL OR {_LON} BETWEEN -125 AND -65)""",
)
add(
    "crop_contiguity",
    """SELECT file_id, lat_count, lon_count, lat_span, lon_span, lat_count = lat_span AND lon_count = lon_span AS contiguous
       FROM v_windows WHERE lat_count > 0 AND lon_count > 0""",
)
add("crop_status", f"SELECT file_id, {_PLAIN_MESSAGE} = 'ok' AS ok, {_PLAIN_MESSAGE} AS message FROM v_windows")
_STRICT = _CROP_MESSAGE.format(
    extra="WHEN lat_count <> lat_span OR lon_count <> lon_span THEN 'Window is not contiguous'"
)
add("crop_status_strict", f"SELECT file_id, {_STRICT} = 'ok' AS ok, {_STRICT} AS message FROM v_windows")
add(
    "crop_strict",
    f"""SELECT file_id, count(*) AS cells FROM v_file_points
        WHERE file_id IN (SELECT file_id FROM v_windows WHERE {_STRICT} = 'ok') GROUP BY file_id""",
)
add(
    "aoi_crop",
    "SELECT area, file_id, variable, count(*) AS cells, count(value) AS unmasked FROM v_cells JOIN (VALUES "
    + ", ".join(f"('{k}', {n}, {s}, {e}, {w})" for k, (n, s, e, w) in AREAS_OF_INTEREST.items())
    + f") AS a(area, n, s, e, w) ON lat BETWEEN s AND n AND {_LON} BETWEEN w AND e GROUP BY ALL",
)

# clip
add("point_in_polygon", "SELECT lat, lon FROM v_inside")
add("point_in_polygon_fine", "SELECT lat, lon FROM v_fine_inside")
_ON = "((bx1 - ax1) * ({y} - ay1) - (bz1 - ay1) * ({x} - ax1) = 0 AND {x} BETWEEN ax1 AND bx1 AND {y} BETWEEN least(ay1, bz1) AND greatest(ay1, bz1))"
_DISSOLVED = f"""
    WITH e AS (
      SELECT polygon_id AS p, CASE WHEN forth THEN x1 ELSE x2 END AS ax, CASE WHEN forth THEN y1 ELSE y2 END AS ay,
             CASE WHEN forth THEN x2 ELSE x1 END AS bx, CASE WHEN forth THEN y2 ELSE y1 END AS bz
      FROM (SELECT *, x1 < x2 OR (x1 = x2 AND y1 < y2) AS forth FROM v_edges)
    ), s AS (SELECT DISTINCT ax, ay, bx, bz FROM e),
    pairs AS (
      SELECT g.ax AS ax1, g.ay AS ay1, g.bx AS bx1, g.bz AS bz1, h.ax AS ax2, h.ay AS ay2, h.bx AS bx2, h.bz AS bz2,
             (g.bx - g.ax) * (h.ay - g.ay) - (g.bz - g.ay) * (h.ax - g.ax) AS oa, (g.bx - g.ax) * (h.bz - g.ay) - (g.bz - g.ay) * (h.bx - g.ax) AS ob,
             (h.bx - h.ax) * (g.ay - h.ay) - (h.bz - h.ay) * (g.ax - h.ax) AS ga, (h.bx - h.ax) * (g.bz - h.ay) - (h.bz - h.ay) * (g.bx - h.ax) AS gb,
             (g.ax, g.ay, g.bx, g.bz) < (h.ax, h.ay, h.bx, h.bz) AS lesser
      FROM s g, s h WHERE g <> h
    ), points AS (
      SELECT ax1, ay1, bx1, bz1, ax2 AS x, ay2 AS y FROM pairs WHERE {_ON.format(x='ax2', y='ay2')}
      UNION SELECT ax1, ay1, bx1, bz1, bx2, bz2 FROM pairs WHERE {_ON.format(x='bx2', y='bz2')}
      UNION SELECT ax1, ay1, bx1, bz1, CASE WHEN lesser THEN ax1 + (bx1 - ax1) * (ga / (ga - gb)) ELSE ax2 + (bx2 - ax2) * (oa / (oa - ob)) END,
                   CASE WHEN lesser THEN ay1 + (bz1 - ay1) * (ga / (ga - gb)) ELSE ay2 + (bz2 - ay2) * (oa / (oa - ob)) END
            FROM pairs WHERE sign(oa) * sign(ob) < 0 AND sign(ga) * sign(gb) < 0
      UNION SELECT ax, ay, bx, bz, ax, ay FROM s UNION SELECT ax, ay, bx, bz, bx, bz FROM s
    ), parts AS (
      SELECT ax1, ay1, bx1, bz1, x, y, lead(x) OVER w AS qx, lead(y) OVER w AS qy FROM points WINDOW w AS (PARTITION BY ax1, ay1, bx1, bz1 ORDER BY x, y)
    ), borders AS (
      SELECT p, x AS ax, y AS ay, qx AS bx, qy AS bz FROM e JOIN parts ON ax = ax1 AND ay = ay1 AND bx = bx1 AND bz = bz1
      WHERE qx IS NOT NULL GROUP BY ALL HAVING count(*) % 2 = 1
    ), each AS (SELECT DISTINCT ax, ay, bx, bz, (ax + bx) / 2 AS mx, (ay + bz) / 2 AS my FROM borders),
    passed AS (
      SELECT m.ax, m.ay, m.bx, m.bz, f.p, count(*) FILTER (WHERE (f.ax, f.ay, f.bx, f.bz) <> (m.ax, m.ay, m.bx, m.bz)) AS before,
             bool_or((f.ax, f.ay, f.bx, f.bz) = (m.ax, m.ay, m.bx, m.bz)) AS own
      FROM each m JOIN borders f ON (f.ax, f.ay, f.bx, f.bz) = (m.ax, m.ay, m.bx, m.bz)
        OR CASE WHEN m.ay <> m.bz THEN f.ay <> f.bz AND least(f.ay, f.bz) <= m.my AND m.my < greatest(f.ay, f.bz)
                       AND f.ax + (m.my - f.ay) * (f.bx - f.ax) / (f.bz - f.ay) < m.mx
                ELSE f.ax <> f.bx AND f.ax <= m.mx AND m.mx < f.bx AND f.ay + (m.mx - f.ax) * (f.bz - f.ay) / (f.bx - f.ax) < m.my END
      GROUP BY ALL
    )
    SELECT ax, ay, bx, bz FROM passed GROUP BY ALL HAVING bool_or(before % 2 = 1) <> bool_or((before % 2 = 1) <> own)"""
add("dissolved_edges", f"SELECT round(ax, 6) AS x1, round(ay, 6) AS y1, round(bx, 6) AS x2, round(bz, 6) AS y2 FROM ({_DISSOLVED})")
add("point_in_dissolved", "SELECT lat, lon FROM v_inside")

_IN = f"(lat, {_LON}) IN (SELECT (lat, lon) FROM v_inside)"
add(
    "clip_mask",
    f"""SELECT file_id, variable, {_TIME}, lat, lon, {_STATE}, {_value()} FROM (
          SELECT file_id, variable, time, lat, lon,
                 CASE WHEN {_IN} THEN value WHEN variable = 'pr' THEN CAST('NaN' AS DOUBLE) ELSE -999 END AS value
          FROM v_cells)""",
)
add("clip_filter", f"SELECT file_id, variable, {_TIME}, lat, lon, {_STATE}, {_value()} FROM v_cells WHERE {_IN}")
add(
    "clip_status",
    f"""SELECT file_id, message = 'Clipped' AS ok, message FROM (
          SELECT f.file_id,
                 CASE WHEN max(p.lat) IS NULL THEN 'No coordinates found'
                      WHEN max(n) < (SELECT min(least(x1, x2)) FROM v_edges) OR min(n) > (SELECT max(greatest(x1, x2)) FROM v_edges)
                        OR max(p.lat) < (SELECT min(least(y1, y2)) FROM v_edges) OR min(p.lat) > (SELECT max(greatest(y1, y2)) FROM v_edges)
                        THEN 'Outside bounds'
                      WHEN count(i.lat) = 0 THEN 'No intersection' ELSE 'Clipped' END AS message
          FROM v_status_files f
          LEFT JOIN (SELECT *, {_LON} AS n FROM v_file_points) p ON f.file_id = p.file_id
          LEFT JOIN v_all_inside i ON p.lat = i.lat AND p.n = i.lon
          GROUP BY f.file_id)""",
)
_D2 = "((bx - ax) * (bx - ax) + (by1 - ay) * (by1 - ay))"
_T = f"greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by1 - ay)) / {_D2}))"
add(
    "clip_buffer",
    f"""SELECT lat, lon FROM v_inside
        UNION
        SELECT lat, lon FROM (
          SELECT lat, lon, {_ex('lon')} AS px, {_ey('lat')} AS py, {_ex('x1')} AS ax, {_ey('y1')} AS ay,
                 {_ex('x2')} AS bx, {_ey('y2')} AS by1
          FROM v_points, v_edges)
        WHERE sqrt(pow(px - (ax + {_T} * (bx - ax)), 2) + pow(py - (ay + {_T} * (by1 - ay)), 2)) <= 40000""",
)
add(
    "clip_status_buffer",
    f"""SELECT * FROM (WITH box AS (SELECT {_ex('min(least(x1, x2))')} - 40000 AS w, {_ex('max(greatest(x1, x2))')} + 40000 AS e,
                        {_ey('min(least(y1, y2))')} - 40000 AS s, {_ey('max(greatest(y1, y2))')} + 40000 AS n FROM v_edges),
             near AS (SELECT lat, lon FROM v_all_inside UNION SELECT lat, lon FROM (
                        SELECT lat, lon, {_ex('lon')} AS px, {_ey('lat')} AS py, {_ex('x1')} AS ax, {_ey('y1')} AS ay,
                               {_ex('x2')} AS bx, {_ey('y2')} AS by1
                        FROM v_all_points, v_edges)
                      WHERE sqrt(pow(px - (ax + {_T} * (bx - ax)), 2) + pow(py - (ay + {_T} * (by1 - ay)), 2)) <= 40000)
        SELECT file_id, message = 'Clipped' AS ok, message FROM (
          SELECT f.file_id,
                 CASE WHEN max(p.lat) IS NULL THEN 'No coordinates found'
                      WHEN {_ex('max(n)')} < (SELECT w FROM box) OR {_ex('min(n)')} > (SELECT e FROM box)
                        OR {_ey('max(p.lat)')} < (SELECT s FROM box) OR {_ey('min(p.lat)')} > (SELECT n FROM box)
                        THEN 'Outside bounds'
                      WHEN count(i.lat) = 0 THEN 'No intersection' ELSE 'Clipped' END AS message
          FROM v_status_files f
          LEFT JOIN (SELECT *, {_LON} AS n FROM v_file_points) p ON f.file_id = p.file_id
          LEFT JOIN near i ON p.lat = i.lat AND p.n = i.lon
          GROUP BY f.file_id))""",
)
add(
    "extents",
    f"""SELECT file_id, min({_LON}) AS min_lon, max({_LON}) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat
        FROM v_file_points GROUP BY file_id
        UNION ALL SELECT 'boundary', min(x1), max(x1), min(y1), max(y1) FROM v_edges""",
)

# conversion
for _name, _var, _expr in (
    ("convert_k_to_c", "tas", "value - 273.15"),
    ("convert_flux_mm_day", "pr", "value * 86400"),
    ("convert_ms_kmh", "sfcWind", "value * 3.6"),
):
    add(
        _name,
        f"SELECT file_id, {_TIME}, lat, lon, {_STATE}, {_value(f'({_expr})', '1.0')} FROM v_cells WHERE variable = '{_var}'",
    )
add(
    "convert_units",
    f"""SELECT file_id, variable, {_TIME}, lat, lon, {_STATE}, {_value(scale='1.0')}, units, unit_conversion FROM (
          SELECT * EXCLUDE (value),
                 CASE variable WHEN 'tas' THEN value - 273.15 WHEN 'pr' THEN value * 86400 ELSE value * 3.6 END AS value,
                 CASE variable WHEN 'tas' THEN 'C' WHEN 'pr' THEN 'mm/day' ELSE 'km/h' END AS units,
                 CASE variable WHEN 'tas' THEN 'From K to C' WHEN 'pr' THEN 'From kg m-2 s-1 to mm/day'
                               ELSE 'From m s-1 to km/h' END AS unit_conversion
          FROM v_cells)""",
)
add(
    "convert_lookup",
    f"""SELECT file_id, variable, target_unit, {_TIME}, lat, lon, {_STATE}, {_value()}, units, unit_conversion FROM (
          SELECT c.* EXCLUDE (value, units), CASE WHEN hit THEN value * scale + shift ELSE value END AS value,
                 CASE WHEN hit THEN target_unit ELSE units END AS units,
                 CASE WHEN hit THEN 'From u1 to ' || target_unit END AS unit_conversion
          FROM (SELECT c.*, scale, shift, scale IS NOT NULL AND units = ' u1 ' AS hit
                FROM (SELECT *, CASE WHEN file_id IN ('file_1', 'file_2') THEN 'u3' ELSE 'u2' END AS target_unit,
                             CASE WHEN file_id = 'file_2' THEN 'u9' ELSE ' u1 ' END AS units FROM v_cells) c
                LEFT JOIN (
                  SELECT ['tas', 'pr', 'zg'][p_partkey % 3 + 1] AS variable, ['u2', 'u3'][p_partkey % 2 + 1] AS target,
                         CAST(max(p_size) AS DOUBLE) AS scale, CAST(min(p_size) AS DOUBLE) AS shift
                  FROM part GROUP BY 1, 2) r ON c.variable = r.variable AND c.target_unit = r.target) c)""",
)
add(
    "convert_status",
    """SELECT file_id, message = 'ok' AS ok, message FROM (
         SELECT f.file_id, CASE WHEN u IS NULL THEN 'Variable ''tas'' not found'
                              WHEN position('K' IN u) = 0 THEN 'Unit mismatch: Expected K, found ' || u ELSE 'ok' END AS message
         FROM v_var_files f
         LEFT JOIN (SELECT file_id, trim(units) AS u FROM
                     (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY var_pos) AS k FROM v_vars WHERE var_name = 'tas')
                    WHERE k = 1) t ON f.file_id = t.file_id)""",
)
add(
    "convert_vars",
    """SELECT file_id, var_pos, var_name, CASE WHEN hit THEN 'C' ELSE units END AS units,
              CASE WHEN hit THEN 'From ' || trim(units) || ' to C' END AS note
       FROM (SELECT *, var_name = 'tas' AND position('K' IN coalesce(units, '')) > 0 AS hit FROM v_vars)""",
)

# aggregation and calendar
_PERIOD = {
    "monthly": "strftime(time, '%Y-%m')",
    "annual": "strftime(time, '%Y')",
    "seasonal": """(CASE WHEN month(time) <= 2 THEN year(time) - 1 ELSE year(time) END) || '-S' ||
        (CASE WHEN month(time) IN (12, 1, 2) THEN 1 WHEN month(time) <= 5 THEN 2 WHEN month(time) <= 8 THEN 3 ELSE 4 END)""",
}
_NUM = "CASE WHEN NOT isnan(value) THEN value END"
_REDUCE = {
    "mean": f"avg({_NUM})",
    "sum": f"coalesce(sum({_NUM}), 0)",
    "min": f"min({_NUM})",
    "max": f"max({_NUM})",
    "std": f"stddev_pop({_NUM})",
    "var": f"var_pop({_NUM})",
    "median": f"median({_NUM})",
    "prod": f"log10(coalesce(product({_NUM}), 1))",
}


def _aggregate(source: str, keys: str, method: str, power: int = 1) -> str:
    whole = "'ok'" if method in ("sum", "prod") else "'nan'"
    scale = "1.0" if method == "prod" else f"CASE WHEN variable = 'pr' THEN {1048576.0 ** power} ELSE 1.0 END"
    return f"""
      SELECT {keys}, CASE WHEN count(value) = 0 THEN 'masked' WHEN count({_NUM}) = 0 THEN {whole} ELSE 'ok' END AS state,
             round(CASE WHEN count(value) > 0 THEN {_REDUCE[method]} END * {scale}, 6) AS value
      FROM {source} GROUP BY {keys}"""


for _freq, _key in _PERIOD.items():
    for _method in _REDUCE:
        add(
            f"agg_{_freq}_{_method}",
            _aggregate(
                f"(SELECT *, {_key} AS period FROM v_cells)",
                "file_id, variable, lat, lon, period",
                _method,
                2 if _method == "var" else 1,
            ),
        )
add(
    "agg_monthly_mean_across_files",
    _aggregate(f"(SELECT *, {_PERIOD['monthly']} AS period FROM v_cells)", "variable, lat, lon, period", "mean"),
)
_LEVELS = """(SELECT c.*, CASE l_suppkey % 3 WHEN 0 THEN CAST(850 AS DOUBLE) WHEN 1 THEN 500 END AS lev FROM (
    SELECT 'file_' || (l_orderkey % 4) AS file_id, l_shipdate AS time, l_suppkey,
           CASE l_linenumber % 3 WHEN 0 THEN 'tas' WHEN 1 THEN 'pr' ELSE 'sfcWind' END AS variable,
           CAST(22.5 + 2.5 * (l_partkey % 100 // 10) AS DOUBLE) AS lat, CAST(230 + 7 * (l_partkey % 10) AS DOUBLE) AS lon,
           CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN CAST('NaN' AS DOUBLE)
                WHEN l_linenumber % 3 = 0 THEN 250 + l_quantity WHEN l_linenumber % 3 = 1 THEN l_quantity / 1048576
                ELSE l_quantity END AS value
    FROM lineitem) c)"""
add(
    "agg_monthly_mean_levels",
    _aggregate(f"(SELECT *, {_PERIOD['monthly']} AS period FROM {_LEVELS})", "file_id, variable, lev, lat, lon, period", "mean"),
)
add(
    "clip_mask_levels",
    f"""SELECT file_id, variable, {_TIME}, lev, lat, lon, {_STATE}, {_value()} FROM (
          SELECT file_id, variable, time, lev, lat, lon, CASE WHEN {_IN} THEN value ELSE CAST('NaN' AS DOUBLE) END AS value
          FROM {_LEVELS})""",
)
add("median_by_ranges", _aggregate("v_cells", "variable", "median"))
add(
    "period_keys",
    f"""SELECT {', '.join(f'{k} AS {f}' for f, k in _PERIOD.items())}, count(*) AS cells FROM v_cells GROUP BY ALL""",
)
add(
    "period_stamp",
    f"""SELECT 'monthly' AS freq, {_PERIOD['monthly']} AS period, count(*) AS cells,
               CAST(CAST(date_trunc('month', time) + INTERVAL 14 DAY AS DATE) AS VARCHAR) AS stamp FROM v_cells GROUP BY ALL
        UNION ALL
        SELECT 'annual', {_PERIOD['annual']}, count(*), CAST(make_date(year(time), 7, 1) AS VARCHAR) FROM v_cells GROUP BY ALL
        UNION ALL
        SELECT 'seasonal', period, count(*), left(period, 4) || ['-02-15', '-05-15', '-08-15', '-11-15'][CAST(right(period, 1) AS INTEGER)]
        FROM (SELECT {_PERIOD['seasonal']} AS period FROM v_cells) GROUP BY ALL""",
)
_DECODED = (
    """SELECT time_value, units, calendar, seconds,
              CAST(CASE calendar WHEN 'standard' THEN year(greg) WHEN 'noleap' THEN n // 365 ELSE k // 360 END AS INTEGER) AS year,
              CAST(CASE calendar WHEN 'standard' THEN month(greg) WHEN 'noleap' THEN l.m ELSE k % 360 // 30 + 1 END AS INTEGER) AS month,
              CAST(CASE calendar WHEN 'standard' THEN day(greg) WHEN 'noleap' THEN l.d ELSE k % 30 + 1 END AS INTEGER) AS day
       FROM (
         SELECT *, origin + CAST(shift AS INTEGER) AS greg, year(origin) * 365 + o.doy + shift AS n,
                year(origin) * 360 + (month(origin) - 1) * 30 + day(origin) - 1 + shift AS k
         FROM (SELECT *, CAST(floor(total / 86400) AS BIGINT) AS shift, total - floor(total / 86400) * 86400 AS seconds
               FROM (SELECT *, time_value * unit_seconds + origin_seconds AS total FROM v_cf)) t
         JOIN v_noleap o ON o.m = month(origin) AND o.d = day(origin)) t
       JOIN v_noleap l ON l.doy = n % 365"""
)
add("cf_decode_time", _DECODED)
_ODD = """
  SELECT *, CASE WHEN calendar = 'lunar' THEN 'Unknown calendar' WHEN units LIKE 'weeks%' THEN 'Unknown time unit'
                 WHEN units LIKE '%never' THEN 'Unreadable reference date' WHEN time_value IS NULL THEN 'No time value' ELSE 'ok' END AS time_status
  FROM (SELECT CASE WHEN l_partkey % 13 > 0 THEN (l_partkey * 31 % 200000 + l_quantity * 0.25) * [24, 1, 86400000][l_linenumber % 3 + 1] END AS time_value,
               CASE l_suppkey % 11 WHEN 0 THEN 'days since never' WHEN 1 THEN 'weeks since 2000-01-01'
                    ELSE ['hrs since 1-1-1 00:00 -06:00', 'days since 1500-02-28T18:30Z', 'msecs since 1700-03-01 00:00:10'][l_linenumber % 3 + 1] END AS units,
               CASE WHEN l_suppkey % 17 = 0 THEN 'lunar' ELSE ['proleptic_gregorian', 'julian', 'standard'][l_orderkey % 3 + 1] END AS calendar
        FROM lineitem)"""
# Days from 1970-01-01: DuckDB's dates are proleptic; a Julian day is counted from 1 March of year 0 by cycles of 1461.
_ODD_DECODED = f"""
  SELECT time_value, units, calendar, time_status, total - floor(total / 86400) * 86400 AS seconds,
         CAST(CASE WHEN old THEN 4 * (z // 1461) + yoe + (mp >= 10)::INT ELSE year(greg) END AS INTEGER) AS year,
         CAST(CASE WHEN old THEN (mp + 2) % 12 + 1 ELSE month(greg) END AS INTEGER) AS month,
         CAST(CASE WHEN old THEN doy - (153 * mp + 2) // 5 + 1 ELSE day(greg) END AS INTEGER) AS day
  FROM (SELECT *, (5 * doy + 2) // 153 AS mp FROM (
    SELECT *, z % 1461 - 365 * yoe AS doy FROM (
      SELECT *, least(z % 1461 // 365, 3) AS yoe FROM (
        SELECT *, n + 719470 AS z, DATE '1970-01-01' + CAST(n AS INTEGER) AS greg,
               calendar = 'julian' OR (calendar = 'standard' AND n < -141427) AS old
        FROM (SELECT *, CASE WHEN total IS NOT NULL THEN CAST(floor(total / 86400) AS BIGINT) + CASE
                     WHEN units LIKE 'hrs%' THEN date_diff('day', DATE '1970-01-01', DATE '0001-01-01') - (calendar <> 'proleptic_gregorian')::INT * 2
                     WHEN units LIKE '%1500%' THEN date_diff('day', DATE '1970-01-01', DATE '1500-02-28') + (calendar <> 'proleptic_gregorian')::INT * 9
                     ELSE date_diff('day', DATE '1970-01-01', DATE '1700-03-01') + (calendar = 'julian')::INT * 11 END END AS n
              FROM (SELECT *, CASE WHEN time_status = 'ok' THEN CASE WHEN units LIKE 'hrs%' THEN time_value * 3600 + 21600
                           WHEN units LIKE '%1500%' THEN time_value * 86400 + 66600 ELSE time_value * 0.001::DOUBLE + 10 END END AS total
                    FROM ({_ODD})))))))"""
add("cf_decode_calendars", _ODD_DECODED)
add(
    "cf_undecoded",
    f"SELECT units, calendar, time_status, count(*) AS times FROM ({_ODD}) WHERE time_status <> 'ok' GROUP BY ALL",
)
add(
    "agg_monthly_mean_calendar",
    f"""SELECT file_id, variable, lat, lon, lpad(CAST(year AS VARCHAR), 4, '0') || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period,
              'ok' AS state, round(avg(time_value), 3) AS value
       FROM (SELECT calendar AS file_id, 'tas' AS variable, CAST(1 AS DOUBLE) AS lat, CAST(2 AS DOUBLE) AS lon, * FROM ({_DECODED}))
       WHERE calendar IN ('noleap', '360_day') GROUP BY ALL""",
)
add(
    "cf_encode_time",
    """SELECT units, calendar, strftime(day, '%Y-%m-%d %H:%M:%S') AS day,
              round(((CASE calendar WHEN 'standard' THEN date_diff('day', origin, CAST(day AS DATE))
                     WHEN 'noleap' THEN year(day) * 365 + s.doy - year(origin) * 365 - o.doy
                     ELSE CASE WHEN day(day) <= 30 THEN year(day) * 360 + month(day) * 30 + day(day)
                            - year(origin) * 360 - month(origin) * 30 - day(origin) END END) * 86400.0
                     + 43200 - origin_seconds) / unit_seconds, 6) AS time_value
       FROM v_cf
       JOIN v_noleap o ON o.m = month(origin) AND o.d = day(origin)
       LEFT JOIN v_noleap s ON s.m = month(day) AND s.d = day(day)""",
)
add(
    "date_normalize",
    """SELECT k AS row_key, raw, CASE WHEN k % 12 = 11 THEN raw ELSE strftime(CASE WHEN k % 12 IN (1, 5, 6, 7, 8) THEN t ELSE date_trunc('day', t) END, '%Y-%m-%dT%H:%M:%SZ') END AS normalized
       FROM (SELECT k, t, CASE k % 12 WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(t, '%Y/%m/%d')
                            WHEN 3 THEN strftime(t, '%Y%m%d') WHEN 4 THEN year(t) || '-' || month(t) || '-' || day(t) WHEN 5 THEN strftime(t, '%Y-%m-%dT%H:%M') || ':00+02:00'
                            WHEN 6 THEN day(t) || ' ' || strftime(t, '%B %Y %H:%M') WHEN 7 THEN strftime(t, '%b ') || day(t) || strftime(t, ', %Y %I:%M %p')
                            WHEN 8 THEN strftime(t, '%Y%m%dT%H%M%S') WHEN 9 THEN strftime(t, '%a ') || day(t) || 'th of ' || strftime(t, '%b %Y')
                            WHEN 10 THEN strftime(t, '%m/%d/%Y') ELSE 'about ' || year(t) END AS raw
             FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS t FROM orders))""",
)

_PAGES = """
    SELECT ['DKRZ', 'CEDA', 'LLNL', 'IPSL', 'NCI'][k % 5 + 1] AS node, 'q' || (k // 5 % 7) AS query, (k // 35) * 100 AS start, (max(k) OVER () // 35) * 100 + 70 AS found,
           (k // 35) * 100 + CASE WHEN k % 29 = 0 THEN 130 WHEN k % 31 = 0 THEN 60 ELSE 100 END AS until
    FROM (SELECT o_orderkey AS k FROM orders) QUALIFY k % 23 <> 0"""
_GAPS = f"""
    SELECT node, query, kind, first, last FROM (
      WITH p AS ({_PAGES}), r AS (
        SELECT node, query, start, until, false AS is_end FROM p UNION ALL SELECT node, query, max(found), max(found), true FROM p GROUP BY node, query
      ), s AS (
        SELECT *, coalesce(max(until) OVER (PARTITION BY node, query ORDER BY start, is_end, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS covered FROM r
      )
      SELECT node, query, 'missing' AS kind, covered AS first, start - 1 AS last FROM s WHERE start > covered
      UNION ALL SELECT node, query, 'repeated', start, least(covered, until) - 1 FROM s WHERE NOT is_end AND least(covered, until) > start)"""
add("search_gaps", _GAPS)
add(
    "search_status",
    f"""SELECT node, query, found, coalesce(missing, 0) AS missing, coalesce(repeated, 0) AS repeated, coalesce(missing, 0) = 0 AS complete
        FROM (SELECT node, query, max(found) AS found FROM ({_PAGES}) GROUP BY ALL)
        LEFT JOIN (SELECT node, query, CAST(sum(CASE kind WHEN 'missing' THEN last - first + 1 ELSE 0 END) AS BIGINT) AS missing,
                          CAST(sum(CASE kind WHEN 'repeated' THEN last - first + 1 ELSE 0 END) AS BIGINT) AS repeated FROM ({_GAPS}) GROUP BY ALL) USING (node, query)""",
)
add(
    "verify_checksum_blocks",
    """SELECT 'body_' || g AS title, g % 5 = 0 OR (g % 3 <> 0 AND g % 7 <> 0) AS ok FROM (SELECT DISTINCT doc_id % 40 AS g FROM documents)""",
)

# catalog
add(
    "base_filename",
    "SELECT file_id, base, regexp_matches(name, '^(tas|pr|huss|psl|ts|uas|vas)_') AS plain FROM v_files",
)
add("catalog_dedup", "SELECT base, copies, file_id, name FROM v_kept")
add(
    "catalog_skipped",
    """SELECT file_id, name, CASE WHEN error IS NOT NULL THEN 'Failed to read or extract metadata: ' || error
              ELSE 'Incomplete metadata (missing: variant_label)' END AS reason
       FROM v_kept WHERE error IS NOT NULL OR variant_label = ''""",
)
add(
    "catalog_flat",
    """SELECT catalog_key, activity_id, source_id, variant_label, variable_id, count(*) AS file_count, min(file_id) AS first_file
       FROM v_entries GROUP BY ALL""",
)

# search and manifests
add("facet_search", "SELECT arrival, instance_id, title FROM v_docs WHERE variable_id = 'tas' AND source_id = 'M3'")
add("facet_search_saved", "SELECT arrival, instance_id, title FROM v_docs WHERE variable_id = 'tas' AND source_id = 'M3'")
add("facet_search_cmip5", "SELECT arrival, title FROM v_docs WHERE variable_id = 'pr' AND frequency = 'mon'")
add("facet_flags", "SELECT arrival, title FROM v_docs WHERE NOT replica AND latest AND data_node = 'CEDA'")
add(
    "http_mirrors",
    """SELECT arrival, CAST(pos AS INTEGER) AS pos, split_part([url_z, url_a][pos + 1], '|', 1) AS mirror
       FROM v_docs, (VALUES (0), (1)) AS p(pos) WHERE service = 'HTTPServer' AND instance_id IS NOT NULL""",
)


def _merged(id_column: str) -> str:
    return f"""
      SELECT d.{id_column}, count(*) AS seen, first(w.data_node) AS data_node, first(w.arrival) AS arrival,
             CASE WHEN count(*) > 1
                  THEN array_to_string(list_sort(list_distinct(list(url_z) || list(url_a))), ' ')
                  ELSE first(url_z) || ' ' || first(url_a) END AS urls
      FROM v_docs d
      JOIN (SELECT {id_column}, data_node, arrival FROM
             (SELECT *, row_number() OVER (PARTITION BY {id_column}
                        ORDER BY CASE WHEN data_node = 'DKRZ' THEN 0 ELSE 1 END, data_node, arrival) AS k FROM v_docs)
            WHERE k = 1) w ON d.{id_column} = w.{id_column}
      GROUP BY d.{id_column}"""


for _key, _id in (("merge_nodes_cmip6", "instance_id"), ("merge_nodes_cmip5", "title")):
    add(
        _key,
        f"""SELECT {_id}, seen, data_node, arrival, CAST(CASE WHEN seen > 1 THEN 0 ELSE pos END AS INTEGER) AS pos, url
            FROM (SELECT *, unnest(string_split(urls, ' ')) AS url, unnest(range(len(string_split(urls, ' ')))) AS pos
                  FROM ({_merged(_id)}))""",
    )
add(
    "mirror_rank",
    f"""SELECT instance_id, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY rank, pos) AS INTEGER) AS place, rank, mirror
        FROM (SELECT instance_id, pos, split_part(u, '|', 1) AS mirror,
                     CASE WHEN contains(regexp_extract(u, '^https?://([^/]+)', 1), 'llnl') THEN 0
                          WHEN contains(regexp_extract(u, '^https?://([^/]+)', 1), 'ceda') THEN 1 ELSE 3 END AS rank
              FROM (SELECT instance_id, unnest(us) AS u, unnest(range(len(us))) AS pos
                    FROM (SELECT instance_id, string_split(urls, ' ') AS us FROM ({_merged('instance_id')})))
              WHERE u LIKE '%|HTTPServer')""",
)
add(
    "manifest_limit",
    "SELECT instance_id, count(*) AS seen FROM v_docs WHERE instance_id IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 25",
)
add("node_priority", "SELECT DISTINCT data_node, CASE WHEN data_node = 'DKRZ' THEN 0 ELSE 1 END AS rank FROM v_docs")
add(
    "vocab_validate",
    """SELECT 'variable_id' AS facet, variable_id AS term, count(*) AS documents FROM v_docs
       WHERE variable_id NOT IN (SELECT ['tas', 'pr'][n_nationkey % 2 + 1] FROM nation) GROUP BY ALL
       UNION ALL
       SELECT 'source_id', source_id, count(*) FROM v_docs
       WHERE source_id NOT IN (SELECT 'M' || r_regionkey FROM region) GROUP BY ALL""",
)
_TITLE = "coalesce(title, 'unknown_file.nc')"
_ACT = "replace(coalesce(activity_id, 'unknown'), '/', '_')"
add(
    "path_cmip6",
    f"""SELECT arrival, variable_id || '/' || replace(resolution, ' ', '') || '/' || {_ACT} || '/' || {_TITLE} AS structured,
               'p_' || {_ACT} || '_' || replace(resolution, ' ', '') || '_' || {_TITLE} AS flat
        FROM v_docs""",
)
add(
    "path_cmip5",
    f"""SELECT arrival, variable_id || '/' || source_id || '/' || coalesce(activity_id, 'unknown') || '/unknown/' || {_TITLE} AS structured,
               'p_' || source_id || '_' || coalesce(activity_id, 'unknown') || '_' || {_TITLE} AS flat
        FROM v_docs""",
)
add(
    "path_other",
    """SELECT output_path, count(*) AS times FROM (
         SELECT output_path FROM v_prism_fine
         UNION ALL SELECT 'COP30/' || filename FROM v_cop30
         UNION ALL SELECT 'USGS10m/' || filename FROM v_usgs) GROUP BY 1""",
)
add(
    "granule_search",
    """SELECT event_id AS granule_id, CAST(user_id % 180 - 90 AS DOUBLE) AS lat, CAST(user_id * 7 % 360 - 180 AS DOUBLE) AS lon
       FROM events
       WHERE user_id % 180 - 90 BETWEEN -30 AND 60 AND user_id * 7 % 360 - 180 BETWEEN -100 AND 120
         AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND event_id % 2 = 0""",
)
# The digests are computed here too, against bodies that exist.
add(
    "verify_checksum",
    """SELECT 'doc_' || doc_id AS title,
              CASE WHEN checksum IS NULL THEN TRUE WHEN NOT at_hand THEN FALSE ELSE checksum = digest END AS ok
       FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS at_hand, digest,
                    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN '0' || digest ELSE digest END AS checksum
             FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN md5(text) ELSE sha256(text) END AS digest FROM documents))""",
)
add("retry_set", "SELECT title, size_bytes FROM v_verified WHERE NOT ok")

# expected files
add("era5_expand", "SELECT * FROM v_era5_expected")
_CODES = ERA5_CODES + UNKNOWN_CODES
add(
    "era5_expand_list",
    f"""SELECT * FROM v_era5_expected UNION ALL
        SELECT request_id, code, part, descr, CAST(year(m) AS INTEGER), CAST(month(m) AS INTEGER), folder || '/' || strftime(m, '%Y%m') || '/' || folder || '.' || file_code || '.'
        FROM (SELECT request_id, v.*, unnest(generate_series(date_trunc('month', start_day), CAST(end_day AS TIMESTAMP), INTERVAL 1 MONTH)) AS m
              FROM v_era5_requests r JOIN v_era5 v ON lower({_list(_CODES)}[(request_id + 3) % {len(_CODES)} + 1]) = v.code)""",
)
add("era5_unknown", "SELECT request_id, code FROM v_era5_requests WHERE code NOT IN (SELECT code FROM v_era5)")
add("prism_expand", "SELECT * FROM v_prism")
add(
    "prism_expand_monthly",
    _prism("chain", "800m", "30s", "monthly", "%Y%m"),
    """requests AS (
         SELECT s_suppkey AS request_id, start_day, start_day + CAST(s_suppkey * 13 % 400 AS INTEGER) AS end_day, variables
         FROM (SELECT s_suppkey, DATE '2020-01-01' + CAST(s_suppkey * 5 % 700 AS INTEGER) AS start_day,
                      CASE s_suppkey % 3 WHEN 0 THEN ['ppt'] WHEN 1 THEN ['tmin', 'tmax'] ELSE ['ppt', 'tmean', 'vpdmax'] END AS variables
               FROM supplier)),
       chain AS (
         SELECT request_id, variables, start_day AS date, end_day FROM requests
         UNION ALL
         SELECT request_id, variables, CAST(date + INTERVAL 1 MONTH AS DATE), end_day FROM chain
         WHERE CAST(date + INTERVAL 1 MONTH AS DATE) <= end_day)""",
)
add(
    "bounds_validate",
    """SELECT box_id, message = 'ok' AS ok, message, NOT (north <= south OR east < west) AS list_ok FROM (
         SELECT *, CASE WHEN north < south THEN 'North must be greater than South'
                        WHEN east < west THEN 'East must be greater than West' ELSE 'ok' END AS message
         FROM (SELECT c_custkey AS box_id, south, west, south + (c_custkey % 5 - 1) * 0.5 AS north, west + (c_custkey % 4 - 1) * 0.75 AS east
               FROM (SELECT c_custkey, (c_custkey * 37 % 600) * 0.25 - 75 AS south, (c_custkey * 91 % 1400) * 0.25 - 176 AS west
                     FROM customer)))""",
)
add("dem_tiles_cop30", "SELECT * FROM v_cop30")
add("dem_tiles_usgs", "SELECT * FROM v_usgs")
add(
    "dem_union",
    """SELECT box_id, 'COP30' AS source, filename, NULL AS tile_id, key FROM v_cop30
       UNION ALL SELECT box_id, 'USGS10m', filename, tile_id, NULL FROM v_usgs""",
)
add(
    "dem_resolve_usgs",
    f"""SELECT * FROM (
          SELECT box_id, tile_id,
                 CASE WHEN tile_id IN (SELECT tile FROM v_usgs_listing WHERE folder = '{USGS_CURRENT}')
                        THEN '{USGS_CURRENT}' || tile_id || '/' || filename
                      WHEN tile_id IN (SELECT tile FROM v_usgs_listing WHERE folder = '{USGS_HISTORICAL}')
                        THEN '{USGS_HISTORICAL}' || tile_id || '/' || filename END AS key, CAST(0 AS BIGINT) AS size_bytes
          FROM v_usgs) WHERE key IS NOT NULL""",
)
add("availability_semi", "SELECT request_id, url FROM v_prism WHERE url IN (SELECT url FROM v_prism_listing)")
add("availability_missing", "SELECT request_id, url FROM v_prism WHERE url NOT IN (SELECT url FROM v_prism_listing)")
add(
    "existing_anti",
    """SELECT request_id, count(*) AS files,
              CASE WHEN output_path IN (SELECT output_path FROM v_prism_existing) THEN 'existing' ELSE 'to do' END AS state
       FROM v_prism GROUP BY ALL""",
)
add("size_match", "SELECT key, size AS size_bytes FROM v_era5_listing WHERE size % 3 = 0")
add(
    "skip_existing",
    f"""SELECT file_id, output FROM (SELECT *, {_DIR} || {_STEM} || '_clipped.nc' AS output FROM v_files)
        WHERE output NOT IN (SELECT {_DIR} || {_STEM} || '_clipped.nc' FROM v_files WHERE error IS NOT NULL)""",
)
add(
    "prefix_first_key",
    """SELECT request_id, prefix, key, size AS size_bytes, regexp_extract(key, '[^/]+$') AS filename
       FROM (SELECT e.request_id, e.prefix, l.key, l.size,
                    row_number() OVER (PARTITION BY e.request_id, e.part, e.prefix ORDER BY l.key) AS k
             FROM v_era5_expected e JOIN v_era5_listing l ON starts_with(l.key, e.prefix))
       WHERE k = 1""",
)
add(
    "prefix_all_keys",
    """SELECT e.prefix, l.key, l.size AS size_bytes
       FROM (SELECT DISTINCT prefix FROM v_era5_expected) e JOIN v_era5_listing l ON starts_with(l.key, e.prefix)""",
)

# whole chains
add(
    "crop_convert_monthly",
    f"""SELECT file_id, variable, lat, lon, period,
               CASE WHEN count(value) = 0 THEN 'masked' WHEN count({_NUM}) = 0 THEN 'nan' ELSE 'ok' END AS state,
               round(avg({_NUM}) - 273.15, 6) AS value
        FROM (SELECT *, {_PERIOD['monthly']} AS period FROM v_cells WHERE variable = 'tas' AND {_DEMO})
        GROUP BY file_id, variable, lat, lon, period""",
)
add(
    "clip_seasonal",
    _aggregate(
        f"(SELECT *, {_PERIOD['seasonal']} AS period FROM v_cells WHERE variable = 'pr' AND {_IN})",
        "file_id, variable, lat, lon, period",
        "sum",
    ),
)
add(
    "download_plan",
    """SELECT output_path, url, count(*) AS times FROM v_prism
       WHERE url IN (SELECT url FROM v_prism_listing) AND output_path NOT IN (SELECT output_path FROM v_prism_existing)
       GROUP BY ALL""",
)
