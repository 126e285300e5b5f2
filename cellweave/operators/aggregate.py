"""Calendar aggregation of cells, NaN- and mask-aware.

Everything but the median is one hash aggregate with map-side combining, so a hot file, variable or
cell shrinks to one row per task before the shuffle. The median counts and narrows (``group_median``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.calendar import FREQUENCIES, period_day, period_key, period_key_ymd, period_stamp
from cellweave.functions.reducers import REDUCERS, numbers, reducer
from cellweave.operators.axes import resolve_time
from cellweave.operators.cftime import encode_times
from cellweave.session import stage

# Columns of a cell that are no dimension: what is reduced, when, and what only describes.
NOT_DIMENSIONS = frozenset(
    ("file_id", "variable", "time", "year", "month", "day", "seconds", "lat", "lon", "value", "units", "fill_value", "unit_conversion")
)
# Samples of a group whose median is one aggregate, and steps into which a pass cuts a larger group's range.
SMALL_GROUP = 100_000
STEPS = 4096


def dimensions(cells: DataFrame) -> list[str]:
    """Further dimensions of the cells (pressure level, depth, member): the columns not named above."""
    return [c for c in cells.columns if c not in NOT_DIMENSIONS]


def aggregate(
    cells: DataFrame,
    freq: str,
    method: str,
    variable: str | None = None,
    across_files: bool = False,
    with_stamp: bool = False,
) -> DataFrame:
    """Period statistics per file, variable and grid cell.

    ``cells`` has either ``time`` or decoded CF parts ``year`` and ``month``. The result has
    ``period`` and ``value``; ``value`` is NULL where all samples were masked and NaN where no
    sample was a number. ``across_files`` merges the periods of all files. Any other column is a
    dimension like latitude and longitude, and kept apart. Cells without a time belong to no period
    and are left out.
    """
    reduced = reducer(method)
    if variable is not None:
        cells = cells.where(F.col("variable") == variable)
    if "time" in cells.columns:
        period, timed = period_key(F.col("time"), freq), F.col("time").isNotNull()
    else:
        period, timed = period_key_ymd(F.col("year"), F.col("month"), freq), F.col("year").isNotNull() & F.col("month").isNotNull()
    keys = ([] if across_files else ["file_id"]) + ["variable", *dimensions(cells), "lat", "lon"]
    samples = cells.where(timed).select(*keys, period.alias("period"), "value")
    keys = [*keys, "period"]
    if method == "median":
        out = group_median(samples, keys)
    else:
        out = samples.groupBy(*keys).agg(reduced(F.col("value")).alias("value"))
    if with_stamp:
        out = out.withColumn("stamp", period_stamp(F.col("period"), freq))
    return out


def group_median(samples: DataFrame, keys: list[str], small: int = SMALL_GROUP) -> DataFrame:
    """Exact median of ``value`` per group, in bounded memory whatever a group's size.

    Groups are counted first, with map-side combining. Those of at most ``small`` samples are one exact
    aggregate, whose memory that count bounds. Larger ones (few, by their number) are narrowed pass by
    pass: a pass counts the samples of each bucket of each group, also on the map side, picks the bucket of
    the two middle ranks, and keeps its samples. Buckets are powers of two first, then equal steps between
    the least and the largest sample that is left, so each pass narrows a group ``STEPS`` times whatever
    its distribution; it ends when both ranks are single values. All tests on values are monotone in
    floating point, so the result is exact. Keys may be NULL (a variable without latitude).
    """
    value = F.col("value")
    facts = stage(samples.groupBy(*keys).agg(F.count(value).alias("n_any"), F.count(numbers(value)).alias("n")), "group-sizes")
    if not facts.where(F.col("n") > small).head(1):
        return samples.groupBy(*keys).agg(reducer("median")(value).alias("value"))
    # At most one group in ``small`` samples is large; a list that measures small is broadcast.
    large = stage(facts.where(F.col("n") > small).select(*keys, "n"), "large-groups")
    rest = _joined(samples.select(*keys, "value"), large.select(*keys), keys, "left_anti")
    out = rest.groupBy(*keys).agg(reducer("median")(value).alias("value"))
    rows = stage(samples.where(numbers(value).isNotNull()).select(*keys, "value").transform(lambda s: _joined(s, large.select(*keys), keys, "left_semi")), "large-samples")
    ranks = large.select(*keys, F.floor((F.col("n") - 1) / 2).alias("r1"), F.floor(F.col("n") / 2).alias("r2"))
    return out.unionByName(_narrowed(rows, ranks, keys))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on the keys, which stay as the left side has them."""
    more = [c for c in right.columns if c not in keys]
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *more)
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
    return joined if how.startswith("left_") else joined.drop(*[f"_{k}" for k in keys])


def _power_bucket(value: Column) -> Column:
    """A number that never falls as the value grows: sign and power of two. 2000 is more than any power."""
    power = F.greatest(F.lit(-1100), F.least(F.lit(1100), F.floor(F.log2(F.abs(value))))) + 2000
    return F.when(value == 0, 0).when(value > 0, power).otherwise(-power).cast("long")


def _narrowed(rows: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the values of ranks ``r1`` and ``r2`` (from 0; equal or neighbours) of each group's rows."""
    value, done = F.col("value"), []
    bucket = _power_bucket(value)
    while True:
        held = rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("m"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        # A group has at most a few thousand buckets, whatever its size.
        listed = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "m", "lo", "hi"))).alias("buckets"))
        start = F.struct(F.lit(0).cast("long").alias("below"), *[F.lit(None).cast(t).alias(c) for c, t in (("lo", "double"), ("hi", "double"), ("x", "double"), ("y", "double"), ("before", "long"))])

        def step(acc: Column, b: Column) -> Column:
            upto = acc["below"] + b["m"]
            has1 = (acc["below"] <= F.col("r1")) & (F.col("r1") < upto)
            has2 = (acc["below"] <= F.col("r2")) & (F.col("r2") < upto)
            split = has1 & ~has2  # the ranks lie on both sides of a border: its two values are the answer
            return F.struct(
                upto.alias("below"),
                F.when(has1, b["lo"]).otherwise(acc["lo"]).alias("lo"),
                F.when(has1, b["hi"]).otherwise(acc["hi"]).alias("hi"),
                F.when(split | (has1 & (b["lo"] == b["hi"])), b["hi"]).otherwise(acc["x"]).alias("x"),
                F.when(has2 & (~has1 | (b["lo"] == b["hi"])), b["lo"]).otherwise(acc["y"]).alias("y"),
                F.when(has1, acc["below"]).otherwise(acc["before"]).alias("before"),
            )

        found = _joined(listed, ranks, keys).select(*keys, "r1", "r2", F.aggregate("buckets", start, step).alias("f"))
        found = stage(found.select(*keys, "r1", "r2", "f.lo", "f.hi", "f.x", "f.y", "f.before"), "middle-buckets")
        done.append(found.where("x IS NOT NULL").select(*keys, ((F.col("x") + F.col("y")) / 2).alias("value")))
        open_ = found.where("x IS NULL")
        if not open_.head(1):
            break
        ranks = open_.select(*keys, (F.col("r1") - F.col("before")).alias("r1"), (F.col("r2") - F.col("before")).alias("r2"))
        between = _joined(rows.select(*keys, "value"), open_.select(*keys, "lo", "hi"), keys).where(value.between(F.col("lo"), F.col("hi")))
        rows = stage(between, "middle-samples")
        share = (value - F.col("lo")) / (F.col("hi") - F.col("lo"))
        bucket = F.least(F.floor(share * STEPS), F.lit(STEPS - 1)).cast("long")
    return reduce(DataFrame.unionByName, done)


def period_axis(periods: DataFrame, freq: str) -> DataFrame:
    """Add ``time_value``: each period's representative day in the file's own ``units`` and ``calendar``.

    ``periods`` has ``period``, ``units`` and ``calendar``; NULL where the units can't be read.
    """
    stamped = period_day(periods, freq).withColumn("seconds", F.lit(0.0))
    return encode_times(stamped).drop("year", "month", "day", "seconds")


def aggregation_details(freq: str, method: str) -> str:
    return f"Method: {method}, Frequency: {freq}"


def aggregate_status(grid_vars: DataFrame, times: DataFrame, variable: str, freq: str, method: str) -> DataFrame:
    """``(file_id, ok, message)`` of each file, before any cell is read.

    ``times`` is the files' time axes with ``time_status`` (see ``cftime.decode_times``). A file fails
    as a whole: without a time axis or the variable, with a time that can't be decoded, or if the
    frequency or the method is unknown.
    """
    found = grid_vars.groupBy("file_id").agg(F.bool_or(F.col("var_name") == variable).alias("has_variable"))
    found = found.join(resolve_time(grid_vars), "file_id")
    bad = times.where("time_status <> 'ok'").groupBy("file_id").agg(F.min("time_status").alias("problem"))
    message = F.when(F.col("time_var").isNull() | ~F.col("has_variable"), f"Required time or variable '{variable}' not found").when(
        F.col("problem").isNotNull(), F.col("problem")
    )
    if freq not in FREQUENCIES:
        message = message.otherwise(f"Unsupported frequency '{freq}'")
    elif method not in REDUCERS:
        message = message.otherwise(f"Unsupported method '{method}'")
    found = found.join(bad, "file_id", "left").select("file_id", message.alias("message"))
    return found.select("file_id", F.col("message").isNull().alias("ok"), F.coalesce("message", F.lit("ok")).alias("message"))


def aggregate_files(
    cells: DataFrame, grid_vars: DataFrame, times: DataFrame, variable: str, freq: str, method: str
) -> tuple[DataFrame, DataFrame]:
    """Rows of the files that can be aggregated, and the status of all of them, side by side.

    The rows have the file's own time axis: ``time_value`` in its ``units`` and ``calendar``, and
    ``aggregation_details``. One failing file does not stop the others. ``cells`` has CF parts.
    """
    status = stage(aggregate_status(grid_vars, times, variable, freq, method), "aggregate-status")
    details = F.lit(aggregation_details(freq, method)).alias("aggregation_details")
    axis = times.groupBy("file_id").agg(F.first("units", True).alias("units"), F.first("calendar", True).alias("calendar"))
    axis = stage(axis.join(status.where("ok").select("file_id"), "file_id"), "file-time-axes")
    if freq not in FREQUENCIES or method not in REDUCERS:  # every file failed
        return cells.limit(0).select("file_id", "variable", "lat", "lon", F.lit("").alias("period"), "value", F.lit(0.0).alias("time_value"), details), status
    cells = cells.join(axis.select("file_id"), "file_id", "left_semi").where(F.col("variable") == variable)
    if method == "median":  # reads its samples more than once
        cells = stage(cells, "median-cells")
    rows = stage(aggregate(cells, freq, method, variable), "period-rows")
    periods = stage(rows.select("file_id", "period").distinct(), "file-periods")
    stamped = period_axis(periods.join(axis, "file_id"), freq).select("file_id", "period", "units", "calendar", "time_value")
    return rows.join(stamped, ["file_id", "period"]).select("*", details), status
