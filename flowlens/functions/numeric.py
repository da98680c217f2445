"""Numeric parsing and missing-value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed value: the text forms a numeric parse accepts (decimal, exponent,
# signed infinity).  A guard in front of try_cast, because Spark alone also
# accepts Java suffixes such as '12d'.
NUMERIC_PATTERN = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?)\s*$"

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def parse_number(c: Column) -> Column:
    """String -> DOUBLE, NULL for anything that is not a plain number or infinity."""
    return F.when(c.rlike(NUMERIC_PATTERN), c.try_cast("double"))


def parses_as_number(c: Column) -> Column:
    """True when the value parses to a number (NaN and NULL do not count).

    Every text the pattern accepts casts to a finite number or an infinity,
    and 'nan' is not accepted, so the pattern alone decides: no cast is
    evaluated for the share count.
    """
    return F.coalesce(c.rlike(NUMERIC_PATTERN), F.lit(False))


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False))


def finite_or_null(c: Column) -> Column:
    """NaN and +/-Inf become NULL: NULL is the only missing value downstream."""
    return F.when(F.isnan(c) | is_infinite(c), F.lit(None)).otherwise(c)


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def is_float_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOAT_TYPES)
