"""Which variable of a file is its latitude, longitude or time axis.

All three rules read ``grid_vars`` and give one row per file. They are min/max aggregates, so each
file is reduced before the shuffle however many variables it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _first(name: Column, match: Column) -> Column:
    return F.min_by(F.when(match, name), F.when(match, F.col("var_pos")))


def _last(name: Column, match: Column) -> Column:
    return F.max_by(F.when(match, name), F.when(match, F.col("var_pos")))


def resolve_for_crop(grid_vars: DataFrame) -> DataFrame:
    """A variable with a standard name is judged by that alone; the last match wins."""
    name, standard = F.col("var_name"), F.col("attrs")["standard_name"]

    def role(standard_name: str, *names: str) -> Column:
        return F.when(standard.isNotNull(), standard == standard_name).otherwise(F.lower(name).isin(*names))

    return grid_vars.groupBy("file_id").agg(
        _last(name, role("latitude", "lat", "latitude")).alias("lat_var"),
        _last(name, role("longitude", "lon", "longitude")).alias("lon_var"),
    )


def resolve_for_clip(grid_vars: DataFrame) -> DataFrame:
    """Standard name or exact name, whichever fits; the first match wins."""
    name, standard = F.col("var_name"), F.coalesce(F.col("attrs")["standard_name"], F.lit(""))

    def role(standard_name: str, *names: str) -> Column:
        return (standard == standard_name) | name.isin(*names)

    return grid_vars.groupBy("file_id").agg(
        _first(name, role("latitude", "lat", "latitude")).alias("lat_var"),
        _first(name, role("longitude", "lon", "longitude")).alias("lon_var"),
    )


def resolve_time(grid_vars: DataFrame) -> DataFrame:
    """First variable marked as time by its attributes, else the first present of three names."""
    name, attrs = F.col("var_name"), F.col("attrs")
    marked = F.coalesce(F.lower(attrs["axis"]) == "t", F.lit(False)) | F.coalesce(
        attrs["standard_name"] == "time", F.lit(False)
    )
    rank = (
        F.when(marked, F.struct(F.lit(0).alias("rule"), F.col("var_pos").alias("pos")))
        .when(name == "time", F.struct(F.lit(1).alias("rule"), F.lit(0).alias("pos")))
        .when(name == "t", F.struct(F.lit(2).alias("rule"), F.lit(0).alias("pos")))
        .when(name == "datetime", F.struct(F.lit(3).alias("rule"), F.lit(0).alias("pos")))
    )
    return grid_vars.groupBy("file_id").agg(F.min_by(F.when(rank.isNotNull(), name), rank).alias("time_var"))
