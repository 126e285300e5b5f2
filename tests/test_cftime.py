"""CF time axes: literal cases, walks through every calendar, encoding as the inverse."""

import calendar as pycal

import pytest
from pyspark.sql import functions as F

from cellweave.operators import aggregate, cftime

AXIS = "k int, time_value double, units string, calendar string"
NAMES = {
    "noleap": lambda y: False, "all_leap": lambda y: True, "julian": lambda y: y % 4 == 0,
    "proleptic_gregorian": lambda y: pycal.isleap(y), "standard": lambda y: y % 4 == 0 if y < 1582 else pycal.isleap(y),
}


def decode(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], AXIS)
    got = cftime.decode_times(df).orderBy("k").collect()
    return [(r["year"], r["month"], r["day"], r["seconds"]) if r["time_status"] == "ok" else r["time_status"] for r in got]


def test_decode_cases(spark):
    cases = [
        ((31.0, "days since 2000-01-01", "standard"), (2000, 2, 1, 0.0)),
        ((59.0, "days since 2000-01-01", "noleap"), (2000, 3, 1, 0.0)),
        ((59.0, "Days Since 2000-01-01", "standard"), (2000, 2, 29, 0.0)),
        ((59.0, "days since 2000-01-01", "360_day"), (2000, 2, 30, 0.0)),
        ((36.5, "hours since 2000-02-28 12:00:00", None), (2000, 3, 1, 1800.0)),
        ((-1.0, "seconds since 1970-01-01", "gregorian"), (1969, 12, 31, 86399.0)),
        ((0.0, "days since 1500-01-01", "proleptic_gregorian"), (1500, 1, 1, 0.0)),
        ((0.0, "days since 1582-10-04", "standard"), (1582, 10, 4, 0.0)),
        ((1.0, "days since 1582-10-04", "standard"), (1582, 10, 15, 0.0)),
        ((1.0, "days since 1582-10-04", "julian"), (1582, 10, 5, 0.0)),
        ((59.0, "days since 2001-01-01", "366_day"), (2001, 2, 29, 0.0)),
        ((1.0, "days since 2000-02-30", "360_day"), (2000, 3, 1, 0.0)),
        ((1.5, "months since 2000-01-01", "360_day"), (2000, 2, 16, 0.0)),
        ((1.0, "days since 1-1-1", "noleap"), (1, 1, 2, 0.0)),
        ((0.0, "hrs since 2000-01-01 00:00 +02:00", "standard"), (1999, 12, 31, 79200.0)),
        ((0.0, "mins since 2000-01-01T05:06:07.5Z", "standard"), (2000, 1, 1, 18367.5)),
        ((0.0, "days since 12345-03-01", "proleptic_gregorian"), (12345, 3, 1, 0.0)),
        ((1.0, "months since 2000-01-01", "standard"), "Unknown time unit"),
        ((1.0, "fortnights since 2000-01-01", "standard"), "Unknown time unit"),
        ((1.0, None, "standard"), "Unknown time unit"),
        ((1.0, "days since 2000-01-01", "lunar"), "Unknown calendar"),
        ((1.0, "days since never", "standard"), "Unreadable reference date"),
        ((1.0, "days since 2000-02-30", "noleap"), "Unreadable reference date"),
        ((1.0, "days since 1582-10-10", "standard"), "Unreadable reference date"),
        ((None, "days since 2000-01-01", "standard"), "No time value"),
        ((float("nan"), "days since 2000-01-01", "standard"), "No time value"),
    ]
    assert decode(spark, [c for c, _ in cases]) == [want for _, want in cases]


def walk(name, first, last):
    """Every day of the years, by counting."""
    for y in range(first, last + 1):
        for m in range(1, 13):
            length = 30 if name == "360_day" else 28 + NAMES[name](y) if m == 2 else pycal.monthrange(2001, m)[1]
            for d in range(1, length + 1):
                if not (name == "standard" and (1582, 10, 5) <= (y, m, d) <= (1582, 10, 14)):
                    yield y, m, d


@pytest.mark.parametrize("name", [*NAMES, "360_day"])
def test_every_day_counts_once_and_comes_back(spark, name):
    days = list(walk(name, 1579, 1605))
    df = spark.range(len(days)).select(
        "id", F.col("id").cast("double").alias("time_value"), F.lit("days since 1579-01-01").alias("units"), F.lit(name).alias("calendar")
    )
    back = cftime.encode_times(cftime.decode_times(df), "again")
    got = back.orderBy("id").select("year", "month", "day", "again").collect()
    assert [(r["year"], r["month"], r["day"]) for r in got] == days
    assert [r["again"] for r in got] == list(range(len(days)))


def test_encode_refuses_days_the_calendar_lacks(spark):
    rows = [(2000, 2, 29, "noleap"), (2000, 1, 31, "360_day"), (2001, 2, 29, "standard"), (2000, 2, 29, "standard")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, year int, month int, day int, calendar string")
    df = df.withColumns({"units": F.lit("days since 2000-01-01"), "seconds": F.lit(0.0)})
    assert [r["time_value"] for r in cftime.encode_times(df).orderBy("k").collect()] == [None, None, None, 59.0]


def test_cells_without_a_time_reach_no_period(spark):
    df = spark.createDataFrame([(0, 1.0, "days since 2000-01-01", "noleap"), (1, 1.0, "days since never", "noleap")], AXIS)
    times = cftime.decode_times(df).selectExpr(
        "'f' AS file_id", "'tas' AS variable", "1D AS lat", "2D AS lon", "year", "month", "time_value AS value"
    )
    assert [(r["period"], r["value"]) for r in aggregate.aggregate(times, "monthly", "mean").collect()] == [("2000-01", 1.0)]
    assert [tuple(r) for r in cftime.undecoded(cftime.decode_times(df)).collect()] == [
        ("days since never", "noleap", "Unreadable reference date", 1)]
