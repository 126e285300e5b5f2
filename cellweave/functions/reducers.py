"""Aggregate columns that tell masked (NULL) and NaN samples apart.

A masked sample is skipped, and so is a NaN. A group with masked samples only stays masked. A group
without any number but with a NaN gives NaN, except for the sum (0) and the product (1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def numbers(value: Column) -> Column:
    """The value, or NULL where it is NaN."""
    return F.when(~F.isnan(value), value)


def _nan_if_empty(reduce: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def build(value: Column) -> Column:
        kept = numbers(value)
        return F.when(F.count(value) == 0, F.lit(None).cast("double")).otherwise(
            F.coalesce(reduce(kept), F.lit(float("nan")))
        )

    return build


def _unit_if_empty(reduce: Callable[[Column], Column], unit: float) -> Callable[[Column], Column]:
    def build(value: Column) -> Column:
        return F.when(F.count(value) == 0, F.lit(None).cast("double")).otherwise(
            F.coalesce(reduce(numbers(value)), F.lit(unit))
        )

    return build


REDUCERS: dict[str, Callable[[Column], Column]] = {
    "mean": _nan_if_empty(F.avg),
    "sum": _unit_if_empty(F.sum, 0.0),
    "min": _nan_if_empty(F.min),
    "max": _nan_if_empty(F.max),
    "std": _nan_if_empty(F.stddev_pop),
    "var": _nan_if_empty(F.var_pop),
    "median": _nan_if_empty(F.median),
    "prod": _unit_if_empty(F.product, 1.0),
}


def reducer(method: str) -> Callable[[Column], Column]:
    if method not in REDUCERS:
        raise ValueError(f"unknown method {method!r}, expected one of {sorted(REDUCERS)}")
    return REDUCERS[method]


def value_state(value: Column) -> Column:
    """``masked``, ``nan`` or ``ok``, for readers that cannot tell NULL from NaN."""
    return F.when(value.isNull(), "masked").when(F.isnan(value), "nan").otherwise("ok")
