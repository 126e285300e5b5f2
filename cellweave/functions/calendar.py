"""Calendar columns: period keys, representative days, date text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.constants import SEASON_MONTHS

FREQUENCIES = ("monthly", "seasonal", "annual")


def season_number(month: Column) -> Column:
    """1 = DJF, 2 = MAM, 3 = JJA, 4 = SON."""
    return F.floor((month % 12 + 3) / 3).cast("int")


def season_year(year: Column, month: Column) -> Column:
    """January and February belong to the year their winter began in."""
    return F.when(month > 2, year).otherwise(year - 1)


def _four_digits(year: Column) -> Column:
    """Digits padded to four, behind the sign; longer years stay whole."""
    text = F.abs(year).cast("string")
    digits = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return F.when(year < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def period_key_ymd(year: Column, month: Column, freq: str) -> Column:
    if freq == "monthly":
        return F.concat(_four_digits(year), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))
    if freq == "annual":
        return _four_digits(year)
    if freq == "seasonal":
        return F.concat(season_year(year, month).cast("string"), F.lit("-S"), season_number(month).cast("string"))
    raise ValueError(f"unknown frequency {freq!r}, expected one of {FREQUENCIES}")


def period_key(time: Column, freq: str) -> Column:
    """``YYYY-MM``, ``YYYY`` or ``YYYY-Sn``."""
    return period_key_ymd(F.year(time), F.month(time), freq)


def period_stamp(key: Column, freq: str) -> Column:
    """Representative day of a period key.

    A season is stamped in the year of its key, so a winter's stamp (15 February) lies before the
    January and February that belong to it. That is how the surveyed tool does it.
    """
    if freq == "monthly":
        return F.to_date(F.concat(key, F.lit("-15")))
    if freq == "annual":
        return F.to_date(F.concat(key, F.lit("-07-01")))
    if freq == "seasonal":
        months = F.array(*[F.lit(m) for m in SEASON_MONTHS])
        number = F.substring_index(key, "-S", -1).cast("int")
        return F.make_date(F.substring_index(key, "-S", 1).cast("int"), F.element_at(months, number), F.lit(15))
    raise ValueError(f"unknown frequency {freq!r}, expected one of {FREQUENCIES}")


def period_day(periods: DataFrame, freq: str) -> DataFrame:
    """Add ``year``, ``month`` and ``day`` of the representative day of ``period``, valid in every calendar."""
    key = F.col("period")
    if freq == "seasonal":
        months = F.array(*[F.lit(m) for m in SEASON_MONTHS])
        year, month, day = F.substring_index(key, "-S", 1), F.element_at(months, F.substring_index(key, "-S", -1).cast("int")), 15
    elif freq == "monthly":
        year, month, day = F.regexp_extract(key, r"^(-?\d+)-(\d\d)$", 1), F.substring_index(key, "-", -1), 15
    elif freq == "annual":
        year, month, day = key, F.lit(7), 1
    else:
        raise ValueError(f"unknown frequency {freq!r}, expected one of {FREQUENCIES}")
    return periods.withColumns({"year": year.cast("int"), "month": month.cast("int"), "day": F.lit(day)})


def month_chain(start: Column, end: Column) -> Column:
    """Dates from ``start`` to ``end`` one month apart, each stepped from the one before.

    31 January is followed by 29 February and then 29 March: a clamped day stays clamped.
    """
    steps = F.months_between(end, F.trunc(start, "month")).cast("int")
    first = F.array(start)
    chain = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        first,
        lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), F.lit(1)))),
    )
    return F.filter(chain, lambda d: d <= end)


# Words of a date text that mean nothing by themselves.
_FILLERS = ("at", "on", "and", "ad", "m", "t", "of", "st", "nd", "rd", "th")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_CLOCK = r"(?i)(?:^|(?<=\d)t|\s+)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,]\d+)?)?\s*([ap]m)?\s*(?:z|utc|gmt|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?)?\s*$"
_DIGITS = r"(?i)^\s*(\d{4})(\d{2})(\d{2})(?:[t\s]?(\d{2})(\d{2})(\d{2})?)?\s*z?\s*$"


def date_text(text: Column) -> Column:
    """The time that a date text names, without a zone; NULL if it names none.

    A text is a date and perhaps a clock time with an offset, which is not applied. The date's words and
    numbers are read by what they are: a month's name, fillers and weekdays, a number of four digits
    as the year; without a name the month comes before the day, unless it is above 12. Eight, twelve or
    fourteen digits alone are year, month, day and so on.
    """
    names = {short: k + 1 for k, m in enumerate(_MONTHS) for short in (m, m[:3])} | {"sept": 9}
    month_of = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    idle = [*_FILLERS, *_WEEKDAYS, *[w[:3] for w in _WEEKDAYS]]

    def clock(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _CLOCK, i), F.lit("")).cast("int"), F.lit(0))

    def digits(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, _DIGITS, i), F.lit("")).cast("int")

    day = F.regexp_replace(text, _CLOCK, "")
    words = F.filter(F.regexp_extract_all(F.lower(day), F.lit("([a-z]+)"), F.lit(1)), lambda w: ~w.isin(idle))
    numbers = F.regexp_extract_all(day, F.lit(r"(\d+)"), F.lit(1))
    number = lambda k: F.get(numbers, F.lit(k)).cast("int")
    size = lambda k: F.length(F.get(numbers, F.lit(k)))
    month = F.try_element_at(month_of, F.get(words, F.lit(0)))
    named = (F.size(words) == 1) & (F.size(numbers) == 2)
    plain = (F.size(words) == 0) & (F.size(numbers) == 3)
    first = size(0) == 4
    one, two = F.when(first, number(1)).otherwise(number(0)), F.when(first, number(2)).otherwise(number(1))
    year = F.when(named, F.when(first, number(0)).when(size(1) == 4, number(1))).when(plain, F.when(first, number(0)).when(size(2) == 4, number(2)))
    months = F.when(named, month).otherwise(F.when(one > 12, two).otherwise(one))
    days = F.when(named, F.when(first, number(1)).otherwise(number(0))).otherwise(F.when(one > 12, one).otherwise(two))
    half = F.lower(F.regexp_extract(text, _CLOCK, 4))
    hour = F.when(half == "pm", clock(1) % 12 + 12).when(half == "am", clock(1) % 12).otherwise(clock(1))
    readable = day.rlike(r"^[0-9A-Za-z\s,.;/'-]*$") & text.isNotNull()
    spelled = F.when(readable, F.try_make_timestamp_ntz(year, months, days, hour, clock(2), clock(3)))
    zero = lambda i: F.coalesce(digits(i), F.lit(0))
    compact = F.try_make_timestamp_ntz(digits(1), digits(2), digits(3), zero(4), zero(5), zero(6))
    return F.coalesce(F.when(text.rlike(_DIGITS), compact), spelled)


def iso_utc(text: Column) -> Column:
    """Date text as ``YYYY-MM-DDTHH:MM:SSZ``, the clock as written; text that is no date comes back as it is."""
    return F.coalesce(F.date_format(date_text(text), "yyyy-MM-dd'T'HH:mm:ss'Z'"), text)
