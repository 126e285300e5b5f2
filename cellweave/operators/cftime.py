"""CF time axes: a number, "<unit> since <date>" and a calendar, to calendar parts and back.

The texts of an axis are parsed once per distinct (units, calendar), into a small table that is staged
and joined back by its measured size. The values are then integer arithmetic in ordinary projections,
one step each, so everything runs as generated code. Decoded axes are staged as well: a filter on the
year, pushed through a dozen dependent steps, would repeat each of them in the next.

All day numbers count from one day per calendar, on years that begin in March: the leap day comes last
and the months have one regular pattern of lengths. Years are astronomical (year 0 exists).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.session import stage

MIXED, GREGORIAN, JULIAN, NOLEAP, ALL_LEAP, DAY360 = range(6)
# Names of the calendars.
CALENDARS = {
    "standard": MIXED,
    "gregorian": MIXED,
    "proleptic_gregorian": GREGORIAN,
    "julian": JULIAN,
    "noleap": NOLEAP,
    "365_day": NOLEAP,
    "all_leap": ALL_LEAP,
    "366_day": ALL_LEAP,
    "360_day": DAY360,
}
# Seconds of each time unit and its spellings.
UNIT_SECONDS = {
    86400.0: ("day", "days", "d"),
    3600.0: ("hour", "hours", "hr", "hrs", "h"),
    60.0: ("minute", "minutes", "min", "mins"),
    1.0: ("second", "seconds", "sec", "secs", "s"),
    1e-3: ("millisecond", "milliseconds", "millisec", "millisecs", "msec", "msecs", "ms"),
    1e-6: ("microsecond", "microseconds", "microsec", "microsecs"),
}
_FIRST_GREGORIAN_DAY = -141427  # 1582-10-15, in days from 1970-01-01
_SINCE = r"(?i)^\s*([a-z_]+)\s+since\s+(.*)$"
_ORIGIN = (
    r"(?i)^([+-]?\d{1,6})-(\d{1,2})-(\d{1,2})(?:(?:T|\s+)(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}(?:\.\d*)?))?)?)?"
    r"\s*(?:Z|UTC|GMT|([+-])(\d{1,2}):?(\d{2})?)?\s*$"
)
_HELD = ("kind", "unit", "origin", "offset", "problem")


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b)


def _leap(kind: Column, year: Column, month: Column, day: Column) -> Column:
    by_four = F.pmod(year, F.lit(4)) == 0
    century = (F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0)
    return (
        F.when(kind == NOLEAP, False)
        .when(kind == ALL_LEAP, True)
        .when((kind == JULIAN) | ((kind == MIXED) & (year < 1582)), by_four)
        .otherwise(by_four & century)
    )


def _with_day_number(df: DataFrame, out: str, kind: str, year: str, month: str, day: str) -> DataFrame:
    """Add ``out``: the day's number in its calendar; NULL for a day that the calendar lacks."""
    k, y, m, d = F.col(kind), F.col(year).cast("long"), F.col(month).cast("long"), F.col(day).cast("long")
    length = F.when(k == DAY360, 30).when(m == 2, F.when(_leap(k, y, m, d), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    written = (y * 100 + m) * 100 + d
    lost = (k == MIXED) & written.between(15821005, 15821014)
    df = df.withColumn("_real", m.between(1, 12) & (d >= 1) & (d <= length) & ~lost)
    df = df.withColumns({"_a": F.when(m <= 2, y - 1).otherwise(y), "_in": _div(F.pmod(m + 9, F.lit(12)) * 153 + 2, 5) + d - 1})
    a, within = F.col("_a"), F.col("_in")
    gregorian = a * 365 + _div(a, 4) - _div(a, 100) + _div(a, 400) + within - 719468
    julian = a * 365 + _div(a, 4) + within - 719470
    number = (
        F.when(k == DAY360, y * 360 + m * 30 + d - 31)
        .when(k == NOLEAP, a * 365 + within)
        .when(k == ALL_LEAP, a * 366 + within)
        .when((k == JULIAN) | ((k == MIXED) & (written < 15821015)), julian)
        .otherwise(gregorian)
    )
    return df.withColumn(out, F.when(F.col("_real"), number)).drop("_real", "_a", "_in")


def _with_date(df: DataFrame, number: str, kind: str) -> DataFrame:
    """Add ``year``, ``month`` and ``day`` of a day number, the inverse of :func:`_with_day_number`."""
    k, n = F.col(kind), F.col(number)
    julian = (k == JULIAN) | ((k == MIXED) & (n < _FIRST_GREGORIAN_DAY))
    cycle = F.when(julian, 1461).when(k == NOLEAP, 365).when(k == ALL_LEAP, 366).when(k == DAY360, 360).otherwise(146097)
    from_start = F.when(julian, n + 719470).when(k.isin(NOLEAP, ALL_LEAP, DAY360), n).otherwise(n + 719468)
    # Whole cycles of the calendar, the day in its cycle, the year in it, the day in its year.
    df = df.withColumns({"_cycle": cycle, "_z": from_start, "_julian": julian})
    df = df.withColumn("_era", F.floor(F.col("_z") / F.col("_cycle")))
    df = df.withColumn("_r", F.col("_z") - F.col("_era") * F.col("_cycle"))
    r = F.col("_r")
    year_of_400 = _div(r - _div(r, 1460) + _div(r, 36524) - _div(r, 146096), 365)
    year_of_4 = _div(r - _div(r, 1460), 365)
    plain = k.isin(NOLEAP, ALL_LEAP, DAY360)
    df = df.withColumn("_y", F.when(plain, 0).when(F.col("_julian"), year_of_4).otherwise(year_of_400).cast("long"))
    y = F.col("_y")
    years = F.when(plain, 1).when(F.col("_julian"), 4).otherwise(400)
    df = df.withColumns({"_a": F.col("_era") * years + y, "_in": r - y * 365 - F.when(plain, 0).otherwise(_div(y, 4) - _div(y, 100))})
    within = F.col("_in")
    df = df.withColumn("_m", F.when(k == DAY360, _div(within, 30)).otherwise(_div(within * 5 + 2, 153)))
    m = F.col("_m")
    df = df.withColumns(
        {
            "month": F.when(k == DAY360, m + 1).otherwise(F.pmod(m + 2, F.lit(12)) + 1).cast("int"),
            "day": F.when(k == DAY360, within - m * 30 + 1).otherwise(within - _div(m * 153 + 2, 5) + 1).cast("int"),
        }
    )
    shifted = (k != DAY360) & (F.col("month") <= 2)
    df = df.withColumn("year", (F.col("_a") + shifted.cast("long")).cast("int"))
    return df.drop("_cycle", "_z", "_julian", "_era", "_r", "_y", "_a", "_in", "_m")


def parse_units(texts: DataFrame) -> DataFrame:
    """Parse (units, calendar) rows: ``kind``, ``unit`` in seconds, ``origin`` day, ``offset`` seconds, ``problem``.

    ``problem`` is NULL or says why times of this axis can't be decoded. Months are a unit in a 360-day
    calendar only. A zone after the reference date counts; a missing calendar is the standard one.
    """
    calendar = F.lower(F.trim(F.coalesce("calendar", F.lit("standard"))))
    kinds = F.create_map(*[F.lit(x) for pair in CALENDARS.items() for x in pair])
    seconds = F.create_map(*[F.lit(x) for n, names in UNIT_SECONDS.items() for name in names for x in (name, n)])
    df = texts.withColumns(
        {
            "kind": F.try_element_at(kinds, calendar),
            "_name": F.lower(F.regexp_extract("units", _SINCE, 1)),
            "_at": F.trim(F.regexp_extract("units", _SINCE, 2)),
        }
    )
    months = (F.col("kind") == DAY360) & F.col("_name").isin("month", "months")
    df = df.withColumn("unit", F.when(months, 30 * 86400.0).otherwise(F.try_element_at(seconds, F.col("_name"))))

    def part(i: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract("_at", _ORIGIN, i), F.lit("")).cast(kind)

    df = df.withColumns({"_year": part(1, "int"), "_month": part(2, "int"), "_day": part(3, "int")})
    zero = lambda i, kind="double": F.coalesce(part(i, kind), F.lit(0))
    sign = F.when(F.regexp_extract("_at", _ORIGIN, 7) == "-", -1).otherwise(1)
    zone = sign * (zero(8) * 3600 + zero(9) * 60)
    df = df.withColumn("offset", zero(4) * 3600 + zero(5) * 60 + zero(6) - zone)
    df = _with_day_number(df, "origin", "kind", "_year", "_month", "_day")
    problem = (
        F.when(F.col("kind").isNull(), "Unknown calendar")
        .when(F.col("unit").isNull(), "Unknown time unit")
        .when(F.col("origin").isNull(), "Unreadable reference date")
    )
    return df.withColumn("problem", problem).drop("_name", "_at", "_year", "_month", "_day")


def _with_axis(df: DataFrame) -> DataFrame:
    axes = parse_units(stage(df.select("units", "calendar").distinct(), "time-units"))
    axes = axes.select(F.col("units").alias("_u"), F.col("calendar").alias("_c"), *[F.col(c).alias(f"_{c}") for c in _HELD])
    return df.join(axes, F.col("units").eqNullSafe(F.col("_u")) & F.col("calendar").eqNullSafe(F.col("_c"))).drop("_u", "_c")


def decode_times(df: DataFrame, value: str = "time_value") -> DataFrame:
    """Add ``year``, ``month``, ``day``, ``seconds`` and ``time_status`` to rows with units and calendar.

    The parts are plain numbers, since 30 February exists in a 360-day calendar but not as a date.
    ``time_status`` is "ok" or says why a row has no time; its parts are NULL then. ``df`` is an axis (a
    row per time step), which is small beside its cells; it is written to the shared folder.
    """
    df = _with_axis(df).withColumn("_problem", F.coalesce("_problem", F.when(F.col(value).isNull() | F.isnan(value), "No time value")))
    total = F.when(F.col("_problem").isNull(), F.col(value) * F.col("_unit") + F.col("_offset"))
    df = df.withColumn("_total", total)
    df = df.withColumn("_days", F.floor(F.col("_total") / 86400))
    df = df.withColumns({"seconds": F.col("_total") - F.col("_days") * 86400, "_number": F.col("_origin") + F.col("_days")})
    df = _with_date(df, "_number", "_kind")
    df = df.withColumn("time_status", F.coalesce("_problem", F.lit("ok")))
    return stage(df.drop("_total", "_days", "_number", *[f"_{c}" for c in _HELD]), "decoded-times")


def encode_times(df: DataFrame, value: str = "time_value") -> DataFrame:
    """Add ``value``: ``year``, ``month``, ``day`` and ``seconds`` in the row's units; NULL for a day its calendar lacks."""
    df = _with_day_number(_with_axis(df), "_number", "_kind", "year", "month", "day")
    total = (F.col("_number") - F.col("_origin")) * 86400 + F.col("seconds") - F.col("_offset")
    encoded = F.when(F.col("_problem").isNull(), total / F.col("_unit"))
    return df.withColumn(value, encoded).drop("_number", *[f"_{c}" for c in _HELD])


def decoded(times: DataFrame) -> DataFrame:
    """The rows that have a time; the others are in :func:`undecoded`."""
    return times.where("time_status = 'ok'")


def undecoded(times: DataFrame) -> DataFrame:
    """How many rows of each axis have no time, and why."""
    return times.where("time_status <> 'ok'").groupBy("units", "calendar", "time_status").agg(F.count("*").alias("times"))
