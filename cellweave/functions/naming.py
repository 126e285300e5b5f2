"""Names, paths and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cellweave.constants import FILE_PREFIXES, PLAIN_VARIABLES, PRISM_BASE_URL, PRISM_RESOLUTION_CODES


def base_filename(name: Column) -> Column:
    """The name without one known project prefix."""
    return F.regexp_replace(name, f"^({'|'.join(FILE_PREFIXES)})", "")


def is_plain(name: Column) -> Column:
    """True if the name starts with a known variable and an underscore."""
    return name.rlike(f"^({'|'.join(PLAIN_VARIABLES)})_")


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """The last path segment without its final suffix; a leading dot is no suffix."""
    return F.regexp_replace(last_segment(name), r"(?<=.)\.[^.]*$", "")


def output_name(name: Column, rel_dir: Column, operation: str, keep_dirs: bool) -> Column:
    """``<stem>_<operation>.nc``, below the input's own folder if ``keep_dirs``."""
    file_name = F.concat(stem(name), F.lit(f"_{operation}.nc"))
    if not keep_dirs:
        return file_name
    return F.concat_ws("/", F.when(F.length(rel_dir) > 0, rel_dir), file_name)


def split_list(text: Column) -> Column:
    """A comma list as an array of trimmed, non-empty entries."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_or(values: Column, default: str) -> Column:
    """First entry of a facet, or the default if there is none."""
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(default))


def path_cmip6(title: Column, facets: Column, save_mode: str, prefix: str = "") -> Column:
    name = F.coalesce(title, F.lit("unknown_file.nc"))
    activity = F.replace(first_or(facets["activity_id"], "unknown"), F.lit("/"), F.lit("_"))
    variable = F.replace(first_or(facets["variable_id"], "unknown"), F.lit("/"), F.lit("_"))
    resolution = F.replace(first_or(facets["nominal_resolution"], "unknown_resolution"), F.lit(" "))
    if save_mode.lower() == "flat":
        return F.concat(F.lit(prefix), F.concat_ws("_", activity, resolution, name))
    return F.concat_ws("/", variable, resolution, activity, name)


def path_cmip5(title: Column, facets: Column, save_mode: str, prefix: str = "") -> Column:
    name = F.coalesce(title, F.lit("unknown_file.nc"))
    variable, model, experiment, ensemble = (
        first_or(facets[f], "unknown") for f in ("variable", "model", "experiment", "ensemble")
    )
    if save_mode.lower() == "flat":
        return F.concat(F.lit(prefix), F.concat_ws("_", model, experiment, name))
    return F.concat_ws("/", variable, model, experiment, ensemble, name)


def path_prism(variable: Column, resolution: Column, name: Column) -> Column:
    return F.concat_ws("/", variable, resolution, name)


def path_dem(source: Column, name: Column) -> Column:
    return F.concat_ws("/", F.coalesce(source, F.lit("dem")), name)


def prism_name(variable: Column, resolution: str, date: Column, time_step: str) -> Column:
    code = PRISM_RESOLUTION_CODES["800m" if resolution == "800m" else "4km"]
    digits = "yyyyMM" if time_step == "monthly" else "yyyyMMdd"
    return F.concat(F.lit("prism_"), variable, F.lit(f"_us_{code}_"), F.date_format(date, digits), F.lit(".zip"))


def prism_url(variable: Column, resolution: str, date: Column, time_step: str) -> Column:
    folder = "800m" if resolution == "800m" else "4km"
    return F.concat_ws(
        "/",
        F.lit(PRISM_BASE_URL),
        F.lit(folder),
        variable,
        F.lit(time_step),
        F.date_format(date, "yyyy"),
        prism_name(variable, resolution, date, time_step),
    )


def _digits(n: Column, width: int) -> Column:
    """Absolute value, zero-filled to at least ``width`` digits and never cut."""
    text = F.abs(n).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def copernicus_lat(lat: Column) -> Column:
    degree = F.floor(lat)
    return F.concat(F.when(lat >= 0, "N").otherwise("S"), _digits(degree, 2))


def copernicus_lon(lon: Column) -> Column:
    degree = F.floor(lon)
    return F.concat(F.when(lon >= 0, "E").otherwise("W"), _digits(degree, 3))


def usgs_tile(lat_degree: Column, lon_degree: Column) -> Column:
    """``nXXwYYY``: always ``n`` and ``w``; a southern latitude keeps its minus sign."""
    signed = F.when(lat_degree < 0, F.concat(F.lit("-"), F.abs(lat_degree).cast("string"))).otherwise(
        _digits(lat_degree, 2)
    )
    return F.concat(F.lit("n"), signed, F.lit("w"), _digits(lon_degree, 3))
