"""Cells from raw arrays: positions along a variable's dimensions meet the values of the file's axes.

``grid_vars`` has a row per variable (its dimensions, attributes, fill value), ``values`` a row per array
element: ``file_id, var_name, pos, value`` with one index per dimension. The axes of a file are chosen by
the rules of ``axes``; each variable gets one row with the short axes along its dimensions, and every
element looks its positions up there. So the cube meets one small table once, whatever its dimensions.
That table is staged: it is broadcast if it measures small, and joined by (file, variable) otherwise,
where adaptive execution splits the elements of a large file. An axis of more than ``SHORT`` steps would
be copied with every element, so it is a table of steps instead, joined by (file, axis, position).

A variable without the latitude or longitude dimension has NULL there; one without time belongs to no
period. All further dimensions are ``levels``: (dimension, value) in the variable's order, with the value
of the variable named like the dimension, or the index if there is none. Scalars have no dimension at all.
Elements equal to the fill value are masked (NULL). Axis variables are not cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellweave.operators import axes, cftime
from cellweave.operators.crop import NO_COORDS
from cellweave.session import stage

RULES = {"crop": (axes.resolve_for_crop, NO_COORDS), "clip": (axes.resolve_for_clip, "No coordinates found")}
NOT_FLAT = "Coordinate variables are not one-dimensional"
# Steps of an axis that go along with its variables as an array, and steps of all long axes that are broadcast at most.
SHORT = 64
BROADCAST_STEPS = 500_000
PARTS = ("year", "month", "day", "seconds")


def _one(variables: str, name: Column) -> Column:
    """The entry of a file's variables with a name."""
    return F.get(F.filter(variables, lambda v: v["var_name"] == name), F.lit(0))


def file_axes(grid_vars: DataFrame, rule: str = "crop") -> DataFrame:
    """Per file: axis variables, the dimensions they lie along, time units and calendar, ``ok`` and ``message``.

    The crop rule takes the first dimension of the axis variable, the clip rule a dimension of its name.
    """
    resolve, lacking = RULES[rule]
    header = F.struct("var_name", "dims", "units", "attrs", "fill_value")
    files = grid_vars.groupBy("file_id").agg(F.collect_list(header).alias("variables"))  # a file's headers
    files = files.join(resolve(grid_vars), "file_id").join(axes.resolve_time(grid_vars), "file_id")

    def dim(role: str) -> Column:
        name = F.col(f"{role}_var")
        return name if rule == "clip" and role != "time" else F.get(_one("variables", name)["dims"], F.lit(0))

    def flat(role: str) -> Column:
        return F.size(_one("variables", F.col(f"{role}_var"))["dims"]) == 1

    time = _one("variables", F.col("time_var"))
    message = F.when(F.col("lat_var").isNull() | F.col("lon_var").isNull(), lacking).when(~(flat("lat") & flat("lon")), NOT_FLAT)
    return files.select(
        "*",
        *[dim(role).alias(f"{role}_dim") for role in ("lat", "lon", "time")],
        time["units"].alias("time_units"),
        time["attrs"]["calendar"].alias("calendar"),
        message.isNull().alias("ok"),
        F.coalesce(message, F.lit("ok")).alias("message"),
    )


def axes_status(grid_vars: DataFrame, rule: str = "crop") -> DataFrame:
    """``(file_id, ok, message)``: whether a file's cells can be placed."""
    return file_axes(grid_vars, rule).select("file_id", "ok", "message")


def time_axes(grid_vars: DataFrame, values: DataFrame) -> DataFrame:
    """The time axis of each file that has one, decoded: ``time_value``, units, calendar, parts and ``time_status``."""
    headers = grid_vars.join(axes.resolve_time(grid_vars), "file_id").where(F.col("var_name") == F.col("time_var"))
    headers = stage(headers.select("file_id", "var_name", "units", F.col("attrs")["calendar"].alias("calendar")), "time-headers")
    steps = values.where(F.size("pos") == 1).join(headers, ["file_id", "var_name"])
    steps = steps.select("file_id", F.get("pos", F.lit(0)).alias("idx"), F.col("value").alias("time_value"), "units", "calendar")
    return cftime.decode_times(stage(steps, "time-steps"))  # read more than once


def _axis_steps(files: DataFrame, values: DataFrame) -> DataFrame:
    """(file_id, var_name, place, value, calendar parts): the steps of each axis variable, numbered from 0 in order."""
    named = F.filter("variables", lambda v: (F.size(v["dims"]) == 1) & (v["var_name"] == F.get(v["dims"], F.lit(0))))
    names = F.array_compact(F.array_distinct(F.concat(F.transform(named, lambda v: v["var_name"]), F.array("lat_var", "lon_var", "time_var"))))
    listed = files.select("file_id", F.explode(names).alias("var_name"), "time_var", "time_units", "calendar")
    along = values.where(F.size("pos") == 1).select("file_id", "var_name", F.get("pos", F.lit(0)).alias("idx"), "value")
    steps = stage(along.join(stage(listed, "axis-names"), ["file_id", "var_name"]), "axis-steps")
    is_time = F.col("var_name") == F.col("time_var")
    times = steps.where(is_time).select("file_id", "var_name", "idx", F.col("value").alias("time_value"), F.col("time_units").alias("units"), "calendar")
    decoded = cftime.decode_times(times).select("file_id", "var_name", "idx", F.col("time_value").alias("value"), *PARTS)
    void = [F.lit(None).cast(decoded.schema[p].dataType).alias(p) for p in PARTS]
    both = decoded.unionByName(steps.where(~F.coalesce(is_time, F.lit(False))).select("file_id", "var_name", "idx", "value", *void))
    place = F.row_number().over(Window.partitionBy("file_id", "var_name").orderBy("idx", "value", *PARTS)) - 1
    return stage(both.select("file_id", "var_name", place.alias("place"), "value", *PARTS), "axis-places")


def _long_steps(places: DataFrame, table: DataFrame, axis: Column) -> DataFrame:
    """The steps of the long axes that variables name, staged so that they are broadcast if they measure small."""
    asked = table.select("file_id", axis.alias("var_name")).where("var_name IS NOT NULL").distinct()
    found = stage(places.join(asked, ["file_id", "var_name"], "left_semi"), "long-axes")
    # Files of repeated values measure less than the memory their rows take.
    return found.hint("merge") if found.count() > BROADCAST_STEPS else found


def cells_from_axes(grid_vars: DataFrame, values: DataFrame, variable: str | None = None, rule: str = "crop") -> DataFrame:
    """``file_id, variable, year, month, day, seconds, lat, lon, levels, value`` of the files whose axes are found.

    :func:`axes_status` has the others. Positions outside an axis give NULL there.
    """
    files = stage(file_axes(grid_vars, rule).where("ok"), "file-axes")
    places = _axis_steps(files, values)
    short = F.array_sort(F.collect_list(F.when(F.col("place") < SHORT, F.struct("place", "value", *PARTS))))
    arrays = places.groupBy("file_id", "var_name").agg((F.max("place") >= SHORT).alias("long"), short.alias("steps"))
    arrays = arrays.groupBy("file_id").agg(F.collect_list(F.struct("var_name", "long", "steps")).alias("arrays"))
    roles = ("lat", "lon", "time")
    named = F.exists(F.col("v.dims"), lambda d: d == F.col("v.var_name")) & (F.size("v.dims") == 1)
    is_axis = named | F.coalesce(F.col("v.var_name").isin(*[F.col(f"{r}_var") for r in roles]), F.lit(False))
    headers = files.join(arrays, "file_id", "left").select("*", F.explode("variables").alias("v")).where(~is_axis)
    if variable is not None:
        headers, values = headers.where(F.col("v.var_name") == variable), values.where(F.col("var_name") == variable)

    def axis(name: Column) -> Column:
        return F.get(F.filter("arrays", lambda a: a["var_name"] == name), F.lit(0))

    def steps(name: Column) -> Column:
        return F.when(~axis(name)["long"], axis(name)["steps"])

    def long(name: Column) -> Column:
        return F.when(axis(name)["long"], name)

    at = {r: F.array_position("v.dims", F.col(f"{r}_dim")).cast("int") - 1 for r in roles}
    others = F.filter(
        F.transform("v.dims", lambda d, i: F.struct(d.alias("dim"), i.alias("at"), steps(d).alias("steps"), long(d).alias("long"))),
        lambda o: ~F.array_contains(F.array(*[F.coalesce(F.col(f"{r}_dim"), F.lit("")) for r in roles]), o["dim"]),
    )
    table = headers.select(
        "file_id",
        F.col("v.var_name").alias("var_name"),
        F.col("v.fill_value").alias("fill_value"),
        *[F.when(at[r] >= 0, at[r]).alias(f"{r}_at") for r in roles],
        *[steps(F.col(f"{r}_var")).alias(f"{r}_steps") for r in roles],
        *[F.when(at[r] >= 0, long(F.col(f"{r}_var"))).alias(f"{r}_long") for r in roles],
        others.alias("others"),
    )
    table = stage(table, "variable-axes")
    rows = values.select("file_id", "var_name", "pos", "value").join(table, ["file_id", "var_name"])

    def step(role: str) -> Column:
        return F.get(F.col(f"{role}_steps"), F.get("pos", F.col(f"{role}_at")))

    def level(o: Column) -> Column:
        index = F.get("pos", o["at"])
        return F.struct(o["dim"].alias("dim"), F.coalesce(F.get(o["steps"], index)["value"], index.cast("double")).alias("value"))

    time = step("time")
    # Where some variable has a long axis: its name, and the position on it.
    last = F.max(F.array_max(F.transform("others", lambda o, i: F.when(o["long"].isNotNull(), i))))
    measured = table.agg(*[F.count(f"{r}_long").alias(r) for r in roles], last.alias("last")).first()
    lookups = {r: (F.col(f"{r}_long"), F.col(f"{r}_at")) for r in roles if measured[r]}
    for i in range(0 if measured["last"] is None else measured["last"] + 1):
        other = F.get("others", F.lit(i))
        lookups[i] = (other["long"], other["at"])
    # Elements with nothing to look up are spread over positions that no axis has.
    nowhere = -1 - F.pmod(F.xxhash64("pos", "value"), F.lit(1 << 20)).cast("int")
    cells = rows.select(
        "file_id",
        F.col("var_name").alias("variable"),
        *[time[p].alias(p) for p in PARTS],
        step("lat")["value"].alias("lat"),
        step("lon")["value"].alias("lon"),
        F.transform("others", level).alias("levels"),
        F.when(~F.col("value").eqNullSafe(F.col("fill_value")), F.col("value")).alias("value"),
        *[
            F.struct(name.alias("axis"), F.coalesce(F.when(name.isNotNull(), F.get("pos", index)), nowhere).alias("place")).alias(f"_{key}")
            for key, (name, index) in lookups.items()
        ],
    )
    columns = [c for c in cells.columns if not c.startswith("_")]
    for key, (name, _) in lookups.items():
        needed = PARTS if key == "time" else ("value",)
        found = _long_steps(places, table, name).select(
            F.col("file_id").alias("_file"), F.col("var_name").alias("_axis"), F.col("place").alias("_place"), *[F.col(c).alias(f"_{c}") for c in needed]
        )
        here = F.col(f"_{key}")
        cells = cells.join(found, (F.col("file_id") == F.col("_file")) & (here["axis"] == F.col("_axis")) & (here["place"] == F.col("_place")), "left")
        if key == "time":
            cells = cells.withColumns({p: F.coalesce(p, f"_{p}") for p in PARTS})
        elif key in roles:
            cells = cells.withColumn(key, F.coalesce(key, "_value"))
        else:
            here_too = F.transform("levels", lambda x, i: F.when(i == key, F.struct(x["dim"].alias("dim"), F.coalesce("_value", x["value"]).alias("value"))).otherwise(x))
            cells = cells.withColumn("levels", F.when(F.col("_value").isNull(), F.col("levels")).otherwise(here_too))
        cells = cells.drop("_file", "_axis", "_place", f"_{key}", *[f"_{c}" for c in needed])
    return cells.select(*columns)
